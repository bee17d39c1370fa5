"""What tasks of the session walk hold: positions by their number, airports in few cells."""

import math
import random

from pyspark.sql import functions as F

from contrail.config import SPARSE
from contrail.fixtures import Tables
from contrail.operators import detector, geo, sessions


def test_many_positions_are_dealt_to_more_tasks(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    wanted = [detector.replay_detector(t.positions, t.airports, SPARSE), sessions.session_features(t.positions, t.airports, SPARSE)]
    wanted = [sorted(map(repr, w.collect())) for w in wanted]
    monkeypatch.setattr(sessions, "TASK_ROWS", 100)
    found = [detector.replay_detector(t.positions, t.airports, SPARSE), sessions.session_features(t.positions, t.airports, SPARSE)]
    assert all(f.rdd.getNumPartitions() == math.ceil(t.positions.count() / 100) > 4 for f in found)
    assert [sorted(map(repr, f.collect())) for f in found] == wanted
    assert sessions.session_features(t.positions, t.airports, SPARSE, tasks=0).rdd.getNumPartitions() <= 4


def test_airports_stand_in_few_cells_and_are_found(spark):
    rng = random.Random(5)
    at = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    airports = [(f"A{i:03}", *p) for i, p in enumerate([(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0), *(at() for _ in range(195))])]
    points = [(i, *p) for i, p in enumerate([(89.9, 70.0), (-89.8, 3.0), (0.1, -179.9), (0.1, 179.9), (0.0, 0.0), (None, 1.0), *(at() for _ in range(600)), *((a[1] * 0.999, a[2] * 0.999) for a in airports)])]
    fields, stands = spark.createDataFrame(airports, "icao_code string, latitude double, longitude double"), spark.createDataFrame(points, "id int, latitude double, longitude double")
    pairs = stands.where("latitude IS NOT NULL").select("id", F.col("latitude").alias("a"), F.col("longitude").alias("b")).crossJoin(fields).select("id", "icao_code", geo.chord_km(geo.unit_sphere(F.col("a"), F.col("b")), geo.unit_sphere(F.col("latitude"), F.col("longitude"))).alias("km"))
    pairs = pairs.collect()
    for max_km in (50.0, 900.0, 25_000.0):
        cells = geo.airport_cells(fields, max_km)
        if max_km < 1000:
            assert cells.agg(F.sum(F.size("near"))).first()[0] < 14 * len(airports)
        wanted = {}
        for r in sorted(pairs, key=lambda r: (r.km, r.icao_code), reverse=True):
            if r.km <= max_km:
                wanted[r.id] = r.icao_code
        for most in (1000, 10):  # broadcast, and dealt by cell and salt
            found = geo.nearest_airport(stands, fields, max_km, most=most).collect()
            assert len(found) == len(points) and {r.id: r.airport for r in found if r.airport} == wanted
