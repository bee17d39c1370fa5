"""Raw payloads to typed tables, and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.scalars import clean_code, strip
from contrail.operators.merge import KEY, one_row_a_key, upsert_flights

SNAPSHOT = "time BIGINT, states ARRAY<ARRAY<STRING>>"
FEED = "ARRAY<STRUCT<icao24: STRING, callsign: STRING, estDepartureAirport: STRING, estArrivalAirport: STRING, firstSeen: BIGINT, lastSeen: BIGINT>>"
PAGE_FLIGHT = "ARRAY<STRUCT<registration: STRING, aircraft_type: STRING, ident_icao: STRING, ident: STRING, origin: STRUCT<code_icao: STRING>, destination: STRUCT<code_icao: STRING>>>"
PAGES = f"arrivals {PAGE_FLIGHT}, enroute {PAGE_FLIGHT}, scheduled {PAGE_FLIGHT}"


def parse_state_snapshots(raw: DataFrame, col: str = "value", place: str | None = None) -> DataFrame:
    """A row per aircraft of each JSON snapshot; all take the snapshot's time. place: a column for the state's place in its snapshot."""
    rows = raw.select(F.from_json(col, SNAPSHOT).alias("j")).select(F.timestamp_seconds("j.time").alias("captured_at"), F.posexplode("j.states").alias("place", "s")).where("s IS NOT NULL")
    at = lambda i: F.try_element_at(F.col("s"), F.lit(i + 1))
    number = lambda i, kind: F.expr(f"try_cast(try_element_at(s, {i + 1}) AS {kind})")
    return rows.select(
        F.lower(strip(at(0))).alias("icao24"), clean_code(at(1)).alias("callsign"), "captured_at",
        number(6, "DOUBLE").alias("latitude"), number(5, "DOUBLE").alias("longitude"), number(7, "FLOAT").alias("altitude_m"),
        number(9, "FLOAT").alias("velocity_ms"), number(10, "FLOAT").alias("heading"), number(8, "BOOLEAN").alias("on_ground"),
        *([F.col("place").alias(place)] if place else []),
    )


def filter_callsign_prefix(states: DataFrame, prefix: str) -> DataFrame:
    return states.where(F.upper(strip(F.col("callsign"))).startswith(prefix.upper()))


def drop_no_fix(states: DataFrame) -> DataFrame:
    return states.where(F.col("latitude").isNotNull())


def fix_counts(states: DataFrame) -> DataFrame:
    return states.agg(F.count("latitude").alias("kept"), F.count_if(F.col("latitude").isNull()).alias("skipped"))


def parse_flight_feed(raw: DataFrame, fleet: DataFrame, col: str = "value") -> DataFrame:
    rows = raw.select(F.explode(F.from_json(col, FEED)).alias("f"))
    flights = rows.select(
        F.lower(strip(F.col("f.icao24"))).alias("icao24"), clean_code(F.col("f.callsign")).alias("callsign"), clean_code(F.col("f.estDepartureAirport")).alias("departure_airport_icao"),
        clean_code(F.col("f.estArrivalAirport")).alias("arrival_airport_icao"), F.timestamp_seconds("f.firstSeen").alias("first_seen"), F.timestamp_seconds("f.lastSeen").alias("last_seen"),
    )
    return flights.join(fleet.select("icao24"), "icao24", "left_semi")


def time_chunks(windows: DataFrame, seconds: int = 7200) -> DataFrame:
    """windows (begin_s, end_s) cut into chunks of at most `seconds`, the last one clipped."""
    starts = F.when(F.col("begin_s") < F.col("end_s"), F.sequence("begin_s", F.col("end_s") - 1, F.lit(seconds)))
    return windows.select("*", F.explode(starts).alias("chunk_begin")).withColumn("chunk_end", F.least(F.col("chunk_begin") + seconds, "end_s"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def load_airports(rows: DataFrame, order: str = "row_no", lists: tuple[str, ...] = ()) -> DataFrame:
    """Large and medium airports with a four-letter code and readable coordinates; later rows replace earlier.

    lists: columns that tell lists of airports apart, if rows hold several; each list keeps its own row of a code.
    """
    code, kind = F.upper(strip(F.col("ident"))), strip(F.col("type"))
    out = rows.where(kind.isin("large_airport", "medium_airport") & (F.length(code) == 4)).select(
        code.alias("icao_code"), F.substring(strip(F.col("name")), 1, 200).alias("name"), F.expr("try_cast(latitude_deg AS DOUBLE)").alias("latitude"), F.expr("try_cast(longitude_deg AS DOUBLE)").alias("longitude"), F.col(order).alias("row_no"), *lists
    )
    out = out.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return out.groupBy("icao_code", *lists).agg(F.max_by(F.struct("name", "latitude", "longitude"), "row_no").alias("a")).select("icao_code", "a.*")


def parse_type_record(raw: DataFrame, col: str = "value") -> DataFrame:
    """raw with aircraft_type and aircraft_subtype of a type look-up's reply, an object or a list whose first is taken."""
    one = F.when(F.col(col).rlike(r"^\s*\["), F.get_json_object(col, "$[0]")).otherwise(F.col(col))
    pick = lambda names: F.coalesce(*(F.nullif(F.get_json_object("one", f"$.{n}"), F.lit("")) for n in names))
    out = raw.withColumn("one", one).withColumns({"aircraft_type": F.nullif(strip(pick(("t", "icaoAircraftClass"))), F.lit("")), "aircraft_subtype": F.nullif(strip(pick(("type", "mdl", "model"))), F.lit(""))})
    return out.drop("one")


def _page_flights(pages: DataFrame, col: str, order: str) -> DataFrame:
    j = pages.select(order, F.from_json(col, PAGES).alias("j"))
    empty = F.expr(f"CAST(array() AS {PAGE_FLIGHT})")
    everything = F.concat(*(F.coalesce(f"j.{k}", empty) for k in ("arrivals", "enroute", "scheduled")))
    return j.select(order, F.posexplode(everything).alias("pos", "f")).withColumn("registration", clean_code(F.col("f.registration")))


def aircraft_from_flight_pages(pages: DataFrame, col: str = "value", order: str = "page_no") -> DataFrame:
    """Aircraft of operator pages by registration: flights, and what their first record says."""
    rows = _page_flights(pages, col, order)
    first = F.min_by(F.struct(clean_code(F.col("f.aircraft_type")).alias("aircraft_type"), clean_code(F.coalesce("f.ident_icao", "f.ident")).alias("callsign"), F.col("f.origin.code_icao").alias("origin"), F.col("f.destination.code_icao").alias("destination")), F.struct(order, "pos"))
    return rows.where("registration IS NOT NULL").groupBy("registration").agg(F.count("*").alias("flight_count"), first.alias("a")).select("registration", "flight_count", "a.*")


def flight_page_counts(pages: DataFrame, col: str = "value", order: str = "page_no") -> DataFrame:
    """How many records of operator pages name a registration, and how many aircraft_from_flight_pages leaves out because they don't."""
    return _page_flights(pages, col, order).agg(F.count("registration").alias("registered"), F.count_if(F.col("registration").isNull()).alias("unregistered"))


def load_review_edits(rows: DataFrame) -> DataFrame:
    """Edits with cleaned fields; `known` is false for actions that aren't understood."""
    blank = lambda c: clean_code(F.col(c), "keep").alias(c)
    action = F.coalesce(clean_code(F.col("action")), F.lit("PENDING"))
    out = rows.select(blank("kind"), blank("key"), action.alias("action"), *(blank(c) for c in ("registration", "type", "subtype", "dep", "arr")))
    return out.withColumn("known", F.col("action").isin("PENDING", "DISMISS", "UPDATE"))


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def list_paths(spark: SparkSession, path: str) -> list[str]:
    """The folders of partitions, as in date=2024-01-01, right below path."""
    fs, where = _fs(spark, path)
    found = [f.getPath() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []
    return [f.toString() for f in found if "=" in f.getName()]


def delete_path(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def write_positions(positions: DataFrame, path: str) -> None:
    """Appends, a folder per day."""
    positions.withColumn("date", F.to_date("captured_at")).repartition("date", F.pmod(F.xxhash64("icao24"), F.lit(8))).write.mode("append").partitionBy("date").parquet(path)


def append_bucketed(positions: DataFrame, table: str, path: str | None = None, buckets: int = 64) -> None:
    """Appends to a catalog table of folders per day and buckets by aircraft, sorted by aircraft and time; path: where a new table lies.

    Jobs that group or walk by aircraft read it without shuffling positions, since a bucket is a task. Rows are
    shuffled once here instead, to a file a day and bucket of each batch.
    """
    rows = positions.withColumn("date", F.to_date("captured_at")).repartition(buckets, "icao24")
    writer = rows.write.format("parquet").mode("append").partitionBy("date").bucketBy(buckets, "icao24").sortBy("icao24", "captured_at")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_positions(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """The positions that write_positions has written, of since <= captured_at <= until; only the folders of those days are read."""
    rows = spark.read.parquet(path)
    for bound, keep in ((since, lambda c, b: c >= b), (until, lambda c, b: c <= b)):
        if bound is not None:
            rows = rows.where(keep(F.col("captured_at"), F.lit(bound)) & keep(F.col("date"), F.to_date(F.lit(bound))))
    return rows


def _boundary(spark: SparkSession, as_of, days: int):
    """The moment `days` before as_of as a column, and its day as a folder names it."""
    edge = F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return edge, spark.range(1).select(F.to_date(edge).cast("string")).first()[0]


def _drop_days(spark: SparkSession, folders: dict[str, str], day: str) -> int:
    """Deletes the folders of the days before `day` and returns how many rows they held."""
    old = [p for d, p in folders.items() if d < day and not d.startswith("__")]
    gone = spark.read.parquet(*old).count() if old else 0
    for folder in old:
        delete_path(spark, folder)
    return gone


def expire_folders(spark: SparkSession, path: str, as_of, days: int = 30) -> int:
    """Deletes the positions older than `days` from write_positions' table and returns how many they were.

    Whole days go as folders, after one count that reads no column of them. Only the day of the boundary is read; what
    stays of it is written beside the table and then takes the folder's place. Running it again deletes nothing.
    """
    edge, day = _boundary(spark, as_of, days)
    folders = {p.rsplit("=", 1)[1]: p for p in list_paths(spark, path)}
    gone = _drop_days(spark, folders, day)
    if day in folders:
        rows = spark.read.parquet(folders[day])
        late = rows.where(F.col("captured_at") < edge).count()
        if late:
            beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
            rows.where((F.col("captured_at") >= edge) | F.col("captured_at").isNull()).write.parquet(beside)
            fs, where = _fs(spark, folders[day])
            fs.delete(where, True)
            if not fs.rename(_fs(spark, beside)[1], where):
                raise OSError(f"{beside} holds what stays of {folders[day]} but couldn't take its place")
        gone += late
    return gone


def expire_bucketed(spark: SparkSession, table: str, as_of, days: int = 30) -> int:
    """expire_folders for append_bucketed's table: the day of the boundary is written anew in the table's buckets."""
    edge, day = _boundary(spark, as_of, days)
    about = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    gone = _drop_days(spark, {p.rsplit("=", 1)[1]: p for p in list_paths(spark, about["Location"])}, day)
    spark.catalog.refreshTable(table)
    rows = spark.table(table).where(F.col("date") == F.lit(day).cast("date")).drop("date")
    late = rows.where(F.col("captured_at") < edge).count()
    if late:
        beside = f"{about['Location'].rstrip('/')}-{uuid.uuid4().hex}"
        try:
            rows.where(F.col("captured_at") >= edge).write.parquet(beside)
            kept = spark.read.schema(rows.schema).parquet(beside).repartition(int(about["Num Buckets"]), "icao24")
            spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (date = DATE'{day}') SELECT * FROM {{kept}}", kept=kept)
        finally:
            delete_path(spark, beside)
    return gone + late


def write_flights(flights: DataFrame, path: str) -> None:
    """Upserts by (icao24, first_seen) into a table with a folder per day; only the days that flights holds are rewritten.

    Of several rows of one key that of the latest last_seen is written, so writing a batch again changes nothing. A day's new
    content is written beside the table first, since a folder can't be read and replaced at once.
    """
    spark = flights.sparkSession
    fresh = one_row_a_key(flights, KEY).withColumn("date", F.to_date("first_seen"))
    if not path_exists(spark, path):
        fresh.hint("rebalance", "date").write.partitionBy("date").parquet(path)  # few files a day, and large days split
        return
    days = fresh.select("date").distinct()
    old = spark.read.schema(fresh.schema).parquet(path).join(days, "date", "left_semi").select(*fresh.columns)
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    try:
        upsert_flights(old, fresh).write.parquet(beside)
        spark.read.parquet(beside).hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    finally:
        delete_path(spark, beside)


def job_run_record(spark: SparkSession, run_type: str, started_at, finished_at, counters: dict[str, int], error: str | None = None) -> DataFrame:
    """One audit row of a job; counters come from DataFrame.observe."""
    row = [run_type, started_at, finished_at, *(int(counters.get(c, 0)) for c in ("aircraft_total", "aircraft_ok", "aircraft_error", "flights_upserted")), error, "error" if error else "ok"]
    return spark.createDataFrame([tuple(row)], "run_type string, started_at timestamp, finished_at timestamp, aircraft_total int, aircraft_ok int, aircraft_error int, flights_upserted int, error_detail string, status string")
