"""Nearest airports and look-ups of positions and flights."""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrail.functions.scalars import EARTH_RADIUS_M, chord_km, unit_sphere


#: Airports up to which their cells are broadcast, and parts that each cell is dealt to beyond.
BROADCAST_AIRPORTS, SALTS = 200_000, 32


def _cells(lat, lon, size: float) -> list:
    return [F.floor(c / size) for c in unit_sphere(lat, lon)]


def airport_cells(airports: DataFrame, max_km: float) -> DataFrame:
    """A row per `cell` with `near`, the airports that can be within max_km of a point in it.

    Cells are cubes of the unit sphere whose edge is the chord of max_km; an airport stands in its own and those of the 26
    around it that the sphere meets within the edge of the airport, so a point's nearest airport is in its own cell's row,
    and poles and the date line need no care. A cell is the hash of its place: should two share one, their airports do too.
    """
    size = _edge(max_km)
    x, y, z = _cells(F.col("latitude"), F.col("longitude"), size)
    rows = airports.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.struct("icao_code", *(c.alias(n) for n, c in zip("xyz", unit_sphere(F.col("latitude"), F.col("longitude")), strict=True))).alias("a"), x.alias("cx"), y.alias("cy"), z.alias("cz"))
    axes = ("cx", "cy", "cz")
    for axis in axes:
        rows = rows.withColumn(axis, F.explode(F.array(*(F.col(axis) + step for step in (-1, 0, 1)))))
    sides = [(F.col(axis) * size, (F.col(axis) + 1) * size, F.col(f"a.{n}")) for axis, n in zip(axes, "xyz", strict=True)]
    square = lambda lengths: reduce(Column.__add__, (c * c for c in lengths))
    apart = square(F.greatest(low - a, a - high, F.lit(0.0)) for low, high, a in sides)
    nearest, farthest = square(F.greatest(low, -high, F.lit(0.0)) for low, high, _ in sides), square(F.greatest(-low, high) for low, high, _ in sides)
    rows = rows.where((apart <= (size * 1.001) ** 2) & (nearest <= 1.000001) & (farthest >= 0.999999))
    return rows.groupBy(F.xxhash64(*axes).alias("cell")).agg(F.collect_list("a").alias("near"))


def _edge(max_km: float) -> float:
    return 2 * math.sin(min(math.pi / 2, max_km * 1000 * 1.001 / (2 * EARTH_RADIUS_M)))


def _distance(point: list[Column], airport: Column) -> Column:
    """great_circle_km and the airport's code, from points of the unit sphere."""
    return F.struct(chord_km(point, [airport[n] for n in "xyz"]).alias("airport_km"), airport["icao_code"].alias("airport"))


def nearest_airports(rows: DataFrame, airports: DataFrame, max_km: float, points: dict[str, tuple], most: int = BROADCAST_AIRPORTS) -> DataFrame:
    """rows with a column (airport_km, airport) per point: the nearest airport within max_km, ties to the smaller code, or null.

    points: by the new column's name, the point's latitude and longitude. Each point meets the one row of its cell, so rows
    are read once and neither grouped nor joined back. Up to `most` airports the cells are broadcast; beyond, cells and
    points are dealt by cell and salt, so that points at a hub, or without coordinates, don't meet in one task.
    """
    size, cells = _edge(max_km), airport_cells(airports, max_km)
    small = airports.limit(most + 1).count() <= most
    keys, carried = ["cell"], rows.columns
    if small:
        cells = F.broadcast(cells)
    else:
        cells = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys.append("salt")
    for name, (lat, lon) in points.items():
        known = lat.isNotNull() & lon.isNotNull()
        cell = F.when(known, F.xxhash64(*_cells(lat, lon, size)))
        if small:
            at = {"cell": cell}
        else:
            spread = F.xxhash64(*carried)
            at = {"cell": F.coalesce(cell, spread), "salt": F.pmod(spread, F.lit(SALTS)).cast("int")}
        met = rows.select("*", *(v.alias(f"p_{k}") for k, v in at.items()), *(c.alias(f"u_{n}") for n, c in zip("xyz", unit_sphere(lat, lon), strict=True)))
        met = met.join(cells.select(*(F.col(k).alias(f"c_{k}") for k in keys), "near"), [F.col(f"p_{k}") == F.col(f"c_{k}") for k in keys], "left")
        found = F.transform("near", partial(_distance, [F.col(f"u_{n}") for n in "xyz"]))
        best = F.when(known, F.array_min(F.filter(found, lambda a: a["airport_km"] <= max_km)))
        rows = met.withColumn(name, best).drop("near", "u_x", "u_y", "u_z", *(f"{side}_{k}" for side in "pc" for k in keys))
    return rows


def nearest_airport(points: DataFrame, airports: DataFrame, max_km: float = 50.0, lat: str = "latitude", lon: str = "longitude", most: int = BROADCAST_AIRPORTS) -> DataFrame:
    """points with `airport` and `airport_km`: the nearest airport within max_km, ties to the smaller code; null without coordinates."""
    found = nearest_airports(points, airports, max_km, {"nearest": (F.col(lat), F.col(lon))}, most)
    return found.withColumns({"airport": F.col("nearest.airport"), "airport_km": F.col("nearest.airport_km")}).drop("nearest")


def flights_with_aircraft(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    return flights.join(aircraft.drop("needs_review"), "icao24")


def latest_position(positions: DataFrame) -> DataFrame:
    """Each aircraft's last position, by aggregation instead of a sort."""
    rest = [c for c in positions.columns if c != "icao24"]
    return positions.groupBy("icao24").agg(F.max_by(F.struct(*rest), "captured_at").alias("p")).select("icao24", "p.*")


def last_completed_flight(flights: DataFrame) -> DataFrame:
    rest = [c for c in flights.columns if c != "icao24"]
    done = flights.where(F.col("arrival_airport_icao").isNotNull())
    return done.groupBy("icao24").agg(F.max_by(F.struct(*rest), F.struct("last_seen", "first_seen")).alias("f")).select("icao24", "f.*")


def open_flights(flights: DataFrame) -> DataFrame:
    return flights.where(F.col("arrival_airport_icao").isNull())


def positions_before(events: DataFrame, positions: DataFrame, n: int = 15) -> DataFrame:
    """events (icao24, at) with `before`: the last n positions of the aircraft strictly before, in order of time.

    All columns of positions are carried, so callers select those they read.

    Events and positions are one sorted sequence per aircraft, so this is a window frame and no range join.
    """
    rest = ["captured_at", *(c for c in positions.columns if c not in ("icao24", "captured_at"))]  # the time first, to sort by it
    rows = positions.select("icao24", F.col("captured_at").alias("at"), F.lit(1).alias("kind"), F.struct(*rest).alias("p"))
    asked = events.select("icao24", "at", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["p"].dataType).alias("p"))
    order = W.partitionBy("icao24").orderBy("at", "kind")
    counted = rows.unionByName(asked).withColumn("nth", F.sum("kind").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # events between two positions share the frame of the position before them
    frame = F.collect_list("p").over(W.partitionBy("icao24").orderBy("nth").rangeBetween(-(n - 1), 0))
    return counted.withColumn("before", frame).where("kind = 0").select("icao24", "at", F.when(F.col("nth") > 0, F.array_sort("before")).otherwise(F.col("before")).alias("before"))


def captured(positions: DataFrame, since: Column, until: Column | None = None) -> DataFrame:
    """The positions of since <= captured_at <= until; where they lie in a folder per day, `date`, only the folders of those days are read."""
    at, day = F.col("captured_at"), dict(positions.dtypes).get("date") == "date"
    rows = positions.where((at >= since) & (F.col("date") >= F.to_date(since))) if day else positions.where(at >= since)
    if until is None:
        return rows
    return rows.where((at <= until) & (F.col("date") <= F.to_date(until))) if day else rows.where(at <= until)


def positions_range(positions: DataFrame, icao24: str, start, end) -> DataFrame:
    return captured(positions, F.lit(start), F.lit(end)).where(F.col("icao24") == icao24).orderBy("captured_at")


def positions_since(positions: DataFrame, since) -> DataFrame:
    return captured(positions, F.lit(since)).orderBy("icao24", "captured_at")
