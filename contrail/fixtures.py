"""The test tables of the jobs, as SQL over the driver's tables. The same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "airports": """
SELECT 'A' || lpad(CAST(s_suppkey AS VARCHAR(10)),3,'0') AS icao_code, s_name AS name,
 CAST((s_suppkey*37) % 1201 AS DOUBLE)/10 - 60 AS latitude, CAST((s_suppkey*733) % 3600 AS DOUBLE)/10 - 180 AS longitude FROM supplier
""",
    "positions": """
WITH b AS (SELECT e.*, CAST(date_part('day', ts) AS BIGINT) AS d, (SELECT count(*) FROM supplier) AS n, (event_id*7+user_id*3) % 10 AS ph FROM events e),
c AS (SELECT b.*, (user_id*31+d*17) % n AS a, CASE WHEN user_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((event_id % 13)-6 AS DOUBLE)/10+0.013 END AS o FROM b)
SELECT lpad(lower(hex(user_id)),6,'0') AS icao24,
 CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '   ' ELSE 'DLH' || CAST(100+(user_id+d) % 3 AS VARCHAR(10)) || ' ' END AS callsign,
 ts AS captured_at, CAST((a*37) % 1201 AS DOUBLE)/10 - 60 + o AS latitude, CAST((a*733) % 3600 AS DOUBLE)/10 - 180 + o AS longitude,
 CAST(CASE WHEN ph<=2 THEN 50 WHEN ph=3 THEN 100 WHEN ph=4 THEN NULL WHEN ph=5 THEN 400 WHEN ph=6 THEN 2000 WHEN ph=9 THEN NULL ELSE 10500+event_id % 50 END AS FLOAT) AS altitude_m,
 CAST(CASE WHEN ph<=2 THEN 5 WHEN ph=3 THEN 20 WHEN ph=5 THEN 80 WHEN ph=6 THEN 150 WHEN ph=9 THEN NULL ELSE 240 END AS FLOAT) AS velocity_ms,
 CAST((event_id*37) % 360 AS FLOAT) AS heading,
 CASE WHEN ph<=2 THEN TRUE WHEN ph=4 THEN NULL ELSE FALSE END AS on_ground FROM c
""",
    "aircraft": """
SELECT lpad(lower(hex(c_custkey)),6,'0') AS icao24,
 CASE WHEN c_custkey % 17 = 0 THEN lpad(hex(c_custkey),6,'0') ELSE 'D-' || lpad(CAST(c_custkey AS VARCHAR(10)),6,'0') END AS registration,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE substr(c_mktsegment,1,4) END AS aircraft_type,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS aircraft_subtype, c_acctbal >= 0 AS is_active,
 (c_custkey % 11 = 0 OR c_custkey % 17 = 0) AS needs_review FROM customer
""",
    "flights": """
WITH b AS (SELECT o_orderkey AS id, lpad(lower(hex(o_custkey)),6,'0') AS icao24,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'DLH' || CAST(o_orderkey % 97 AS VARCHAR(10)) END AS callsign,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'A00' || CAST((o_orderkey*31+o_custkey) % 5 AS VARCHAR(10)) END AS departure_airport_icao,
 CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'UNKN' ELSE 'A00' || CAST((o_orderkey*17+o_custkey*3+1) % 5 AS VARCHAR(10)) END AS arrival_airport_icao,
 CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' SECOND * (o_orderkey % 86400) AS first_seen, 3600+(o_orderkey*61) % 39600 AS dur FROM orders)
SELECT id, icao24, callsign, departure_airport_icao, arrival_airport_icao, first_seen, first_seen + INTERVAL '1' SECOND * dur AS last_seen,
 CAST(first_seen AS DATE) AS flight_date, CAST(floor(CAST(dur AS DOUBLE)/60) AS INT) AS duration_minutes,
 coalesce(departure_airport_icao=arrival_airport_icao,FALSE) OR id % 13 = 0 AS needs_review FROM b
""",
    "registry": """
SELECT c_custkey*2 AS row_no, upper(lpad(hex(c_custkey),6,'0')) || ' ' AS icao24, CASE WHEN c_custkey % 37 = 0 THEN '' ELSE 'd-a' || lpad(CAST(c_custkey AS VARCHAR(10)),6,'0') END AS registration,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(substr(c_mktsegment,1,4)) END AS typecode, 'Model ' || CAST(c_nationkey AS VARCHAR(10)) AS model,
 CASE c_nationkey % 3 WHEN 0 THEN 'dlh' WHEN 1 THEN '' ELSE 'XXX' END AS operatoricao FROM customer WHERE c_custkey % 10 <> 3
UNION ALL SELECT c_custkey*2+1, lower(lpad(hex(c_custkey),6,'0')), 'D-ADUP', 'DUPL', 'Dup', 'DLH' FROM customer WHERE c_custkey % 50 = 0
""",
    "batch_runs": """
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'state_poller' WHEN 1 THEN 'flight_detector' WHEN 2 THEN 'fleet_discovery' WHEN 3 THEN 'fleet_refresh' ELSE 'pos_cleanup' END AS run_type,
 ts AS started_at, CASE WHEN event_type='view' THEN NULL ELSE ts + INTERVAL '1' SECOND * (event_id % 90) END AS finished_at, CAST(user_id AS INT) AS aircraft_total, CAST(event_id % 40 AS INT) AS aircraft_ok, CAST(event_id % 3 AS INT) AS aircraft_error, CAST(event_id % 100 AS INT) AS flights_upserted,
 CASE WHEN event_type='error' THEN props END AS error_detail, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'running' ELSE 'ok' END AS status FROM events
""",
    "flight_seed": """
SELECT lpad(lower(hex(user_id)),6,'0') AS icao24, 'DLH' || CAST(100+user_id % 3 AS VARCHAR(10)) AS callsign, 'A000' AS departure_airport_icao,
 CASE WHEN user_id % 4 = 1 THEN (CASE WHEN user_id % 8 = 1 THEN 'UNKN' ELSE 'A001' END) END AS arrival_airport_icao,
 CAST(t0 - INTERVAL '1' HOUR AS TIMESTAMP) AS first_seen, CAST(CASE WHEN user_id % 4 = 1 THEN t0 + INTERVAL '36' HOUR ELSE t0 END AS TIMESTAMP) AS last_seen, FALSE AS needs_review
FROM (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id) e WHERE user_id % 4 IN (0, 1)
""",
}

BASE = ("events", "supplier", "customer", "orders")
TIMES = ("captured_at", "started_at", "finished_at", "first_seen", "last_seen")


class Tables:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        for name in BASE:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        df = self.spark.sql(VIEWS[name])
        return df.withColumns({c: F.col(c).cast("timestamp") for c in TIMES if c in df.columns})
