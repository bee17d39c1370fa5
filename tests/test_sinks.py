"""Sinks with keys, buckets and audit rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contrail.audit import StreamAudit, audited
from contrail.config import SPARSE
from contrail.fixtures import Tables
from contrail.operators import fleet, geo, sessions
from contrail.plans import reports
from contrail.sources import payloads
from contrail.sources.database import connected, upsert_jdbc

START = datetime(2024, 1, 1, 12)
FLIGHT = "icao24 string, first_seen timestamp, last_seen timestamp, arrival string, dep string"


def flight(icao24, hours, arrival, dep="AAAA"):
    return icao24, START, START + timedelta(hours=hours), arrival, dep


def test_upsert_into_a_database(spark, tmp_path):
    url, properties = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    columns = '"icao24" VARCHAR(8) NOT NULL, "first_seen" TIMESTAMP NOT NULL, "last_seen" TIMESTAMP, "arrival" VARCHAR(4), "dep" VARCHAR(4)'
    with connected(spark, url, properties) as statement:
        statement.executeUpdate(f'CREATE TABLE flights ({columns}, PRIMARY KEY ("icao24", "first_seen"))')
    keys, update = ["icao24", "first_seen"], ["last_seen", "arrival"]

    def put(*rows):
        upsert_jdbc(spark.createDataFrame(list(rows), FLIGHT).repartition(3), url, "flights", keys, update, properties)

    def held():
        return sorted((r.icao24, (r.last_seen - START).seconds // 3600, r.arrival, r.dep) for r in spark.read.jdbc(url, "flights", properties=properties).collect())

    put(flight("a", 1, None), flight("b", 1, "BBBB"))
    for _ in range(2):  # a batch with a repeated key, written twice
        put(flight("a", 3, "CCCC", "XXXX"), flight("a", 2, None, "XXXX"), flight("c", 1, None))
        assert held() == [("a", 3, "CCCC", "AAAA"), ("b", 1, "BBBB", "AAAA"), ("c", 1, None, "AAAA")]
    put()
    with pytest.raises(Exception):  # the code is too long for its column: nothing of the batch is written
        put(flight("d", 1, None), flight("e", 1, "TOO LONG"))
    assert len(held()) == 3
    broken = spark.createDataFrame([flight("f", 1, None)], FLIGHT).withColumn("dep", F.raise_error(F.lit("unreadable")).cast("string"))
    with pytest.raises(Exception, match="unreadable"):
        upsert_jdbc(broken, url, "flights", keys, update, properties)
    tables = spark.read.jdbc(url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') q", properties=properties)
    assert [r[0] for r in tables.collect()] == ["FLIGHTS"]  # no staging table stays


def test_sessions_of_bucketed_positions_need_no_shuffle(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    half = F.xxhash64("icao24", "captured_at") % 2 == 0
    for part in (half, ~half):
        payloads.append_bucketed(t.positions.where(part), "bucketed_positions", str(tmp_path / "positions"), 8)
    table = spark.table("bucketed_positions")
    walked = sessions.split_sessions(table, SPARSE)
    assert "Exchange" not in walked._jdf.queryExecution().executedPlan().toString()
    found, wanted = (sessions.session_features(p, t.airports, SPARSE) for p in (table, t.positions))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning(icao24" not in plan
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    spark.sql("DROP TABLE bucketed_positions")


def test_retention_of_bucketed_positions_keeps_the_buckets(spark, tmp_path):
    rows = [(f"a{i % 5}", START + timedelta(hours=6 * i)) for i in range(40)]
    payloads.append_bucketed(spark.createDataFrame(rows, "icao24 string, captured_at timestamp"), "kept_positions", str(tmp_path / "positions"), 4)
    as_of = START + timedelta(days=9)
    for gone in (20, 0):  # a rerun deletes nothing
        assert payloads.expire_bucketed(spark, "kept_positions", as_of, 4) == gone
        table = spark.table("kept_positions")
        assert sorted((r.icao24, r.captured_at) for r in table.collect()) == sorted(rows[20:])
        counted = table.groupBy("icao24").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert {r.icao24: r["count"] for r in counted.collect()} == dict.fromkeys((f"a{i}" for i in range(5)), 4)
    days = {p.name for p in (tmp_path / "positions").iterdir() if p.name.startswith("date=")}
    assert days == {f"date=2024-01-{d:02}" for d in range(6, 12)}
    assert payloads.expire_bucketed(spark, "kept_positions", as_of + timedelta(days=99), 4) == 20 and spark.table("kept_positions").count() == 0
    spark.sql("DROP TABLE kept_positions")


def test_recent_aircraft_read_recent_folders_only(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{d}", START + timedelta(days=d)) for d in range(20)], "icao24 string, captured_at timestamp")
    payloads.write_positions(rows, str(tmp_path / "positions"))
    small = spark.createDataFrame([("a19",), ("a1",)], "icao24 string"), spark.createDataFrame([], "icao24 string, flight_date date")
    as_of, table = START + timedelta(days=19), spark.read.parquet(str(tmp_path / "positions"))
    found = fleet.seen_lately(table, as_of, 7)
    assert sorted(r[0] for r in found.collect()) == sorted(f"a{d}" for d in range(12, 20)) == sorted(r[0] for r in fleet.seen_lately(rows, as_of, 7).collect())
    asked = [geo.positions_since(table, as_of), geo.positions_range(table, "a18", as_of - timedelta(days=3), as_of), reports.fleet_list(*small, table, as_of).where("currently_tracking")]
    assert [sorted(r.icao24 for r in rows.collect()) for rows in asked] == [["a19"], ["a18"], ["a19"]]
    for rows in (found, *asked):
        assert "PartitionFilters: [isnotnull(date" in rows._jdf.queryExecution().executedPlan().toString()


def test_a_run_that_raises_leaves_a_row(spark, tmp_path):
    path = str(tmp_path / "runs")
    with pytest.raises(RuntimeError), audited(spark, path, "state_poller") as run:
        run["aircraft_ok"] = 3
        raise RuntimeError("no answer")
    with audited(spark, path, "state_poller") as run:
        run["aircraft_ok"] = 4
    rows = spark.read.parquet(path).orderBy("aircraft_ok").collect()
    assert [(r.aircraft_ok, r.status, r.error_detail) for r in rows] == [(3, "error", "no answer"), (4, "ok", None)]
    assert all(r.started_at <= r.finished_at for r in rows)


def test_streams_leave_audit_rows(spark, tmp_path):
    path, kind = str(tmp_path / "runs"), "icao24 string, latitude double"
    spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    listener = StreamAudit(spark, path)
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        counted = rows.observe("audit", F.count("*").alias("aircraft_total"), F.count("latitude").alias("aircraft_ok"))

        def fail(batch, epoch):
            raise ValueError("the sink is full")

        for name, sink in (("poller", lambda batch, epoch: batch.count()), ("full", fail), (None, fail)):
            writer = counted.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True)
            query = (writer.queryName(name) if name else writer).start()
            if sink is fail:
                with pytest.raises(Exception):
                    query.awaitTermination(60)
            else:
                query.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    found = sorted((r.run_type, r.status, r.aircraft_total, r.aircraft_ok, "the sink is full" in (r.error_detail or "")) for r in spark.read.parquet(path).collect())
    assert found == [("full", "error", 0, 0, True), ("poller", "ok", 3, 2, False)]
