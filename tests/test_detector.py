"""Hand-made tracks for the session walk, and the cell join against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contrail.config import DetectorConfig
from contrail.operators.detector import detect_flights, incremental_detect, tails
from contrail.operators.geo import nearest_airport
from contrail.sources.payloads import write_positions

START = datetime(2024, 1, 1, 12)
AIRPORTS = [("AAAA", "A", 10.0, 10.0), ("BBBB", "B", 20.0, 20.0)]
POSITION = "icao24 string, callsign string, captured_at timestamp, latitude double, longitude double, altitude_m float, velocity_ms float, on_ground boolean"
AT = {"A": (10.0, 10.0), "B": (20.0, 20.0), "sea": (0.0, -30.0)}


def track(*points, icao24="3c0001", callsign="DLH1"):
    """points: (minute, place, altitude, on_ground[, callsign])."""
    return [(icao24, p[4] if len(p) > 4 else callsign, START + timedelta(minutes=p[0]), *AT[p[1]], None if p[2] is None else float(p[2]), 200.0, p[3]) for p in points]


@pytest.fixture(scope="module")
def airports(spark):
    return spark.createDataFrame(AIRPORTS, "icao_code string, name string, latitude double, longitude double")


def run(spark, airports, rows, stored=None):
    positions = spark.createDataFrame(rows, POSITION)
    return sorted(((r.departure_airport_icao, r.arrival_airport_icao, r.needs_review, r.callsign) for r in detect_flights(positions, airports, stored, DetectorConfig()).collect()), key=repr)


def test_whole_flight_in_one_session(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (4, "B", 400, False), (6, "B", 0, True))
    assert run(spark, airports, rows) == [("AAAA", "BBBB", False, "DLH1")]


def test_only_the_first_sector_of_a_session_is_found(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (4, "B", 0, True), (6, "B", 1000, False), (8, "A", 0, True))
    assert run(spark, airports, rows) == [("AAAA", "BBBB", False, "DLH1")]


def test_coverage_gap_with_the_same_callsign_continues(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (60, "sea", 10000, False), (120, "B", 400, False), (122, "B", 0, True))
    assert run(spark, airports, rows) == [("AAAA", "BBBB", False, "DLH1")]


def test_another_callsign_closes_as_unknown(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (60, "sea", 10000, False, "DLH2"))
    assert run(spark, airports, rows) == [("AAAA", "UNKN", True, "DLH1"), (None, None, True, "DLH2")]


def test_missed_departure_while_climbing(spark, airports):
    rows = track((0, "A", 500, False), (2, "A", 1500, False), (60, "B", 0, True))
    assert run(spark, airports, rows) == [("AAAA", "BBBB", False, "DLH1")]


def test_cruise_start_needs_review(spark, airports):
    assert run(spark, airports, track((0, "sea", 10000, False), (2, "sea", 10000, False))) == [(None, None, True, "DLH1")]


def test_landing_without_airport_leaves_the_row_open(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (4, "sea", 0, True))
    assert run(spark, airports, rows) == [("AAAA", None, False, "DLH1")]


def test_return_to_the_departure_needs_review(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (4, "A", 0, True))
    assert run(spark, airports, rows) == [("AAAA", "AAAA", True, "DLH1")]


def test_frozen_low_positions_are_a_landing(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (4, "B", 400, False), (6, "B", 400, False), (8, "B", 400, False))
    assert run(spark, airports, rows) == [("AAAA", "BBBB", False, "DLH1")]


def test_unknown_ground_flags_only_extend(spark, airports):
    rows = track((0, "A", 0, True), (2, "A", 1000, False), (60, "B", None, None))
    assert run(spark, airports, rows) == [("AAAA", None, False, "DLH1")]


def test_a_gap_of_eight_minutes_does_not_split(spark, airports):
    rows = track((0, "A", 0, True), (8, "A", 1000, False))
    assert run(spark, airports, rows) == [("AAAA", None, False, "DLH1")]
    later = [*rows[:1], (*rows[1][:2], rows[1][2] + timedelta(seconds=1), *rows[1][3:])]
    assert run(spark, airports, later) == [(None, None, True, "DLH1")]


def test_a_landing_before_the_look_back_closes_an_open_flight(spark, airports):
    """Case 4: the stored positions before the first session end low and descending at B."""
    stored = spark.createDataFrame([("3c0001", "DLH1", "AAAA", None, START - timedelta(hours=1), START, False)], "icao24 string, callsign string, departure_airport_icao string, arrival_airport_icao string, first_seen timestamp, last_seen timestamp, needs_review boolean")
    rows = spark.createDataFrame(track((0, "B", 900, False), (2, "B", 400, False), (4, "B", 300, False), (60, "B", 0, True)), POSITION)
    found = detect_flights(rows, airports, stored, DetectorConfig(), since=START + timedelta(minutes=30)).collect()
    assert [(r.path, r.arrival_airport_icao, r.last_seen) for r in found] == [("4", "BBBB", START + timedelta(minutes=4))]


def test_sessions_covered_by_a_completed_flight_are_skipped(spark, airports):
    stored = spark.createDataFrame([("3c0001", "DLH1", "AAAA", "BBBB", START, START + timedelta(hours=1), False)], "icao24 string, callsign string, departure_airport_icao string, arrival_airport_icao string, first_seen timestamp, last_seen timestamp, needs_review boolean")
    assert run(spark, airports, track((0, "A", 0, True), (2, "A", 1000, False)), stored) == []


def test_nearest_airport_equals_brute_force(spark):
    rng = random.Random(3)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(89.9, 0.0), (-89.9, 170.0), (0.0, 179.95), (0.0, -179.95)]
    ports = [(f"P{i:03}", "x", la, lo) for i, (la, lo) in enumerate(spots)]
    points = [(la + rng.uniform(-0.4, 0.4), lo + rng.uniform(-0.4, 0.4)) for la, lo in spots for _ in range(5)] + [(89.95, 180.0), (0.0, 180.0), (None, 1.0)]
    points = [(p[0] if p[0] is None else max(-90.0, min(90.0, p[0])), p[1]) for p in points]
    found = nearest_airport(spark.createDataFrame(points, "latitude double, longitude double"), spark.createDataFrame(ports, "icao_code string, name string, latitude double, longitude double"), 50.0)

    def km(a, b):
        xyz = [(math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)), math.sin(math.radians(la))) for la, lo in (a, b)]
        return round(2 * 6378.168 * math.asin(min(1, math.dist(*xyz) / 2)), 3)

    def nearest(p):
        best = min((km(p, q[2:]), q[0]) for q in ports)
        return best[1] if best[0] <= 50 else None

    rows = found.collect()
    assert len(rows) == len(points)
    assert all(r.airport == (nearest((r.latitude, r.longitude)) if r.latitude is not None else None) for r in rows)


def test_salted_cells_give_the_same_airports(spark, airports):
    rng = random.Random(5)
    points = [(i, 10.0, 10.0) for i in range(300)] + [(i, None, 1.0) for i in range(300)] + [(i, rng.uniform(9, 21), rng.uniform(9, 21)) for i in range(300)]
    rows = spark.createDataFrame(points, "id int, latitude double, longitude double")
    plain, salted = (nearest_airport(rows, airports, 50.0, most=most) for most in (1000, 0))
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))
    assert "airport" in salted.columns and salted.where("airport IS NOT NULL").count() >= 300
    plan = plain._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("Scan") == 2  # points once, airports once


def test_a_run_with_tails_equals_one_over_all_history(spark, airports, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        minute, ground = 0, True
        for _ in range(60):
            minute += rng.choice((2, 2, 4, 9, 60))
            ground = ground if rng.random() < 0.8 else not ground
            spot = rng.choice((10.0, 20.0)) if ground else rng.choice((10.0, 15.0, 20.0))
            rows.append((f"{i:06x}", "DLH1", START + timedelta(minutes=minute), spot, spot, 100.0 if ground else 4000.0, 5.0 if ground else 200.0, 0.0, ground))
    positions = spark.createDataFrame(rows, "icao24 string, callsign string, captured_at timestamp, latitude double, longitude double, altitude_m float, velocity_ms float, heading float, on_ground boolean")
    cfg, cut = DetectorConfig(stale_hours=3), START + timedelta(minutes=200)
    stored = detect_flights(positions.where(F.col("captured_at") < F.lit(cut)), airports, None, cfg).drop("path")
    as_of = START + timedelta(days=1)
    path = str(tmp_path / "positions")
    write_positions(positions, path)
    early = tails(positions, START + timedelta(minutes=100), cfg)
    between = positions.where(F.col("captured_at") >= F.lit(START + timedelta(minutes=100)))
    tail = tails(between, cut, cfg, early)
    assert sorted(map(tuple, tail.collect())) == sorted(map(tuple, tails(positions, cut, cfg).collect()))
    whole = incremental_detect(positions, stored, airports, cut, as_of, cfg)
    found = incremental_detect(spark.read.parquet(path), stored, airports, cut, as_of, cfg, tail)
    assert sorted(map(str, found.select(*whole.columns).collect())) == sorted(map(str, whole.collect())) and whole.count() > 40
