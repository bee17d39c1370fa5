"""The streaming forms over files, with late rows and restarts."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contrail.config import DetectorConfig
from contrail.functions.scalars import clean_code, is_on_ground
from contrail.operators.detector import detect_flights
from contrail.operators.geo import nearest_airport
from contrail.sources import payloads
from contrail.streaming import detect, jobs

START = datetime(2024, 1, 1, 12)
POSITION = "icao24 string, callsign string, captured_at timestamp, latitude double, longitude double, altitude_m float, velocity_ms float, heading float, on_ground boolean"
CFG = DetectorConfig()


class Stream:
    """Files of positions that a query reads one a batch; after each file the query is started again from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()

    def put(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), POSITION).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def read(self):
        return self.spark.readStream.schema(POSITION).parquet(str(self.folder / "in"))

    def run(self, df, mode="append"):
        out = str(self.folder / "out")
        df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", str(self.folder / "check")).trigger(availableNow=True).start().awaitTermination(120)
        return [tuple(r) for r in self.spark.read.schema(df.schema).parquet(out).collect()]


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


def at(minute, icao24="3c0001", callsign="DLH1", lat=10.0, lon=10.0, alt=5000.0, ground=False):
    return icao24, callsign, START + timedelta(minutes=minute), lat, lon, alt, 5.0 if ground else 200.0, 0.0, ground


def test_stream_positions(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(n, minute, *states):
        when = int((START + timedelta(minutes=minute)).timestamp())
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"time": when, "states": [[s, "dlh1 ", "X", 0, 0, 10.0, lat, 100.0, False, 200.0, 0.0] for s, lat in states]}))

    def run():
        raw = spark.readStream.text(str(tmp_path / "in"))
        query = jobs.stream_positions(raw).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.icao24, r.callsign) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(1, 0, ("3C0001", 1.0), ("3c0001", 1.0), ("3c0002", None))
    assert run() == [("3c0001", "DLH1")]
    put(2, 0, ("3c0001", 1.0), ("3c0003", 1.0))  # after a restart: one repeat, one new
    assert run() == [("3c0001", "DLH1"), ("3c0003", "DLH1")]


def test_stream_sessions_and_late_rows(stream):
    stream.put(at(0), at(8), at(17))
    assert stream.run(jobs.stream_sessions(stream.read(), CFG)) == []  # no session is over yet
    stream.put(at(120))
    stream.run(jobs.stream_sessions(stream.read(), CFG))
    stream.put(at(3), at(121))  # the first is later than the watermark allows
    found = sorted(r[1:4] for r in stream.run(jobs.stream_sessions(stream.read(), CFG)))
    assert found == [(START, START + timedelta(minutes=8), 2), (START + timedelta(minutes=17), START + timedelta(minutes=17), 1)]


def test_stream_activity(stream):
    rows = [at(0), at(1, "3c0002", ground=True), at(1), at(3, "3c0002"), at(3.5, "3c0002", ground=True)]
    stream.put(*rows[:2])
    stream.run(jobs.stream_activity(stream.read()))
    stream.put(*rows[2:], at(1.5, "3c0003"))  # the last one comes late, but in time
    stream.run(jobs.stream_activity(stream.read()))
    stream.put(at(60))
    stream.run(jobs.stream_activity(stream.read()))
    stream.put(at(61), at(0, "3c0009"))  # too late
    found = stream.run(jobs.stream_activity(stream.read()))
    whole = jobs.stream_activity(stream.spark.createDataFrame([*rows, at(1.5, "3c0003")], POSITION))
    assert sorted(found) == sorted(map(tuple, whole.collect())) == [(START, 3, 2), (START + timedelta(minutes=2), 1, 1)]


def test_stream_detect(spark, stream, tmp_path):
    airports = spark.createDataFrame([("AAAA", "A", 10.0, 10.0), ("BBBB", "B", 20.0, 20.0)], "icao_code string, name string, latitude double, longitude double")
    flights = str(tmp_path / "flights")

    def run():
        jobs.stream_detect(stream.read(), flights, airports, CFG, str(tmp_path / "check")).awaitTermination(300)
        rows = spark.read.parquet(flights).orderBy("icao24", "first_seen").collect() if payloads.path_exists(spark, flights) else []
        return [(r.icao24, r.departure_airport_icao, r.arrival_airport_icao, r.needs_review) for r in rows]

    first = [at(4), at(0, ground=True), at(0, "3c0002", "DLH2", ground=True), at(2, "3c0002", "DLH2")]
    stream.put(*first)
    assert run() == []  # no session is over
    second = [at(2), at(6, lat=20.0, lon=20.0), at(8, lat=20.0, lon=20.0, ground=True)]  # the first one comes late, but in time
    stream.put(*second)
    stream.put(at(60, "3c0009"))
    assert run() == [("3c0001", "AAAA", "BBBB", False), ("3c0002", "AAAA", None, False)]
    whole = detect_flights(spark.createDataFrame(first + second, POSITION), airports, None, CFG).drop("path")
    columns = whole.columns
    assert sorted(map(tuple, spark.read.parquet(flights).select(*columns).collect())) == sorted(map(tuple, whole.collect()))
    stream.put(at(3, "3c0002", "DLH2", ground=True), at(60 * 25, "3c0003", "DLH3"))  # one row too late; the second aircraft fell silent a day ago
    assert run()[:2] == [("3c0001", "AAAA", "BBBB", False), ("3c0002", "AAAA", "UNKN", True)]


def test_state_equals_the_batch_detector(spark):
    """Random tracks in random batches: the state's last version of each flight is what the detector finds over all rows."""
    rng = random.Random(11)
    ports = [("AAAA", "A", 10.0, 10.0), ("BBBB", "B", 10.02, 10.02), ("CCCC", "C", 20.0, 20.0)]
    rows = []
    for i in range(60):
        minute, ground = 0, rng.random() < 0.5
        for _ in range(rng.randint(1, 40)):
            minute += rng.choice((2, 2, 2, 4, 8, 9, 60))
            ground = ground if rng.random() < 0.75 else not ground
            low = rng.random() < 0.4
            lat = rng.choice((10.0, 10.0, 10.01, 15.0, 20.0, None))
            known = rng.random() < 0.85
            alt = None if rng.random() < 0.15 else rng.choice((50.0, 300.0, 450.0)) if low or ground else rng.choice((2000.0, 9000.0))
            rows.append((f"{i:06x}", rng.choice((None, " ", "DLH1", "DLH1 ", "DLH2")), START + timedelta(minutes=minute), lat, lat, alt, 5.0 if ground and rng.random() < 0.3 else 200.0, 0.0, ground if known else None))
    airports = spark.createDataFrame(ports, "icao_code string, name string, latitude double, longitude double")
    positions = spark.createDataFrame(rows, POSITION)
    cfg = DetectorConfig(stale_hours=100_000)
    wanted = detect_flights(positions, airports, None, cfg)
    columns = wanted.columns
    near = nearest_airport(positions, airports, cfg.airport_radius_km)
    ground = is_on_ground(F.col("on_ground"), F.col("velocity_ms"), F.col("altitude_m"), cfg)
    fed = near.select("icao24", F.unix_micros("captured_at").alias("ts"), "latitude", "longitude", F.col("altitude_m").cast("double"), ground.alias("ground"), clean_code(F.col("callsign"), "keep").alias("cs"), "airport", "airport_km").toPandas()
    found = {}
    for icao24, frame in fed.groupby("icao24"):
        state = detect.Aircraft(icao24, cfg)
        cuts = sorted(rng.sample(range(len(frame) + 1), min(3, len(frame))))
        for part in (frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True)):
            state.take(detect.rows_of(part.sample(frac=1, random_state=1)))
            state.advance(int(part["ts"].max()) - 1 if len(part) else 0)
            state = detect.Aircraft.load(icao24, cfg, state.dump()) if not state.changed else state
            found |= {(icao24, f["first_seen"]): f for f in state.flights()}
        state.advance(int(frame["ts"].max()) + 10**12)
        found |= {(icao24, f["first_seen"]): f for f in state.flights()}
    key = lambda rows: sorted(rows, key=str)
    timed = wanted.withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})
    assert key(tuple(f[c] for c in columns) for f in found.values()) == key(tuple(r) for r in timed.select(*columns).collect())


def test_action_sink_applies_batches_once_and_in_order(spark, tmp_path):
    kind = "kind string, icao24 string, first_seen timestamp, last_seen timestamp, callsign string, departure_airport_icao string, arrival_airport_icao string, needs_review boolean"
    path = str(tmp_path / "table")
    sink = jobs.action_sink(path)
    row = lambda what, icao24, hours, arr, cs="DLH1": (what, icao24, START, START + timedelta(hours=hours), cs, "AAAA", arr, False)
    batches = [
        [row("open", "a", 1, None), row("open", "a", 2, None, "DLH2"), row("open", "b", 1, "BBBB"), row("update", "none", 1, "BBBB")],
        [row("update", "a", 3, "CCCC", None), row("update", "b", 9, "DDDD"), row("open", "c", 1, None)],
        [row("update", "a", 5, "EEEE"), row("update", "c", 4, None)],
    ]
    for n in (0, 0, 1, 2, 1, 0, 2):
        sink(spark.createDataFrame(batches[n], kind), n)
    found = jobs.read_actions(spark, path).select("icao24", "callsign", "arrival_airport_icao", F.hour("last_seen"))
    assert sorted(map(tuple, found.collect())) == [("a", "DLH2", "CCCC", 15), ("b", "DLH1", "BBBB", 13), ("c", "DLH1", None, 16)]
    assert jobs.versions(spark, path)[-1] == 2


def test_expire_folders_drops_days_and_counts(spark, tmp_path):
    rows = [at(60 * h, f"{h:06x}") for h in range(0, 24 * 5, 3)]  # from noon on
    path = str(tmp_path / "positions")
    payloads.write_positions(spark.createDataFrame(rows, POSITION), path)
    payloads.write_positions(spark.createDataFrame(rows[:1], POSITION), path)
    as_of = START + timedelta(days=12, hours=5)
    edge = as_of - timedelta(days=10)
    assert payloads.expire_folders(spark, path, as_of, 10) == 1 + sum(r[2] < edge for r in rows)
    left = spark.read.parquet(path)
    assert sorted(r.captured_at for r in left.collect()) == [r[2] for r in rows if r[2] >= edge]
    assert min(p.rsplit("=", 1)[1] for p in payloads.list_paths(spark, path)) == "2024-01-03"
    assert payloads.expire_folders(spark, path, as_of, 10) == 0
    n = left.count()
    assert payloads.expire_folders(spark, path, as_of, 1) == n and payloads.list_paths(spark, path) == []
    assert payloads.expire_folders(spark, path, as_of, 1) == payloads.expire_folders(spark, str(tmp_path / "none"), as_of, 1) == 0


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "positions")
    payloads.write_positions(spark.createDataFrame([at(60 * h) for h in range(0, 24 * 5, 3)], POSITION), path)
    found = payloads.read_positions(spark, path, START + timedelta(days=1), START + timedelta(days=2))
    assert found.count() == 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-02" in plan and "2024-01-03" in plan
    assert len(found.inputFiles()) >= 1 and len({f.split("date=")[1][:10] for f in found.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) == 2


def test_repeated_keys_of_a_batch_are_one_row(spark, tmp_path):
    kind = "icao24 string, first_seen timestamp, last_seen timestamp, callsign string, departure_airport_icao string, arrival_airport_icao string, needs_review boolean"
    batch = spark.createDataFrame([("a", START, START + timedelta(hours=h), f"DLH{h}", "AAAA", None, False) for h in (1, 3, 2)], kind)
    for _ in range(2):
        payloads.write_flights(batch, str(tmp_path / "t"))
        assert [r.callsign for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["DLH3"]


def test_merge_sink_and_repeated_batches(spark, tmp_path):
    kind = "icao24 string, first_seen timestamp, last_seen timestamp, callsign string, departure_airport_icao string, arrival_airport_icao string, needs_review boolean"
    path = str(tmp_path / "table")
    sink = jobs.merge_sink(path)
    row = lambda icao24, day, arr: (icao24, START + timedelta(days=day), START + timedelta(days=day, hours=1), "DLH1", "AAAA", arr, False)
    sink(spark.createDataFrame([row("a", 0, None), row("b", 0, "BBBB"), row("c", 1, "BBBB")], kind), 0)
    for _ in range(2):
        sink(spark.createDataFrame([row("a", 0, "CCCC"), row("d", 0, None)], kind), 1)
    found = spark.read.parquet(path).select("icao24", "arrival_airport_icao", F.dayofmonth("first_seen"))
    assert sorted(map(tuple, found.collect())) == [("a", "CCCC", 1), ("b", "BBBB", 1), ("c", "BBBB", 2), ("d", None, 1)]
