"""Rotation of one aircraft type around one focus route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrail.functions.scalars import route_label, utc_weekday, weekday_name

DEP, ARR = "departure_airport_icao", "arrival_airport_icao"


@dataclass(frozen=True)
class Focus:
    aircraft_type: str
    dep: str
    arr: str

    @property
    def route(self) -> str:
        return f"{self.dep}-{self.arr}"


def _flown(flights: DataFrame, aircraft: DataFrame, focus: Focus, reviewed: bool = True) -> DataFrame:
    """Completed flights of the type with registration and route; unreviewed ones only, unless told otherwise."""
    rows = flights.where(F.col(DEP).isNotNull() & F.col(ARR).isNotNull())
    if reviewed:
        rows = rows.where(~F.col("needs_review"))
    planes = aircraft.where(F.col("aircraft_type") == focus.aircraft_type).select("icao24", "registration", "is_active")
    return rows.join(planes, "icao24").withColumn("route", route_label(F.col(DEP), F.col(ARR), None))


def _in_order() -> W:
    return W.partitionBy("registration").orderBy("first_seen", "id")


def rotation_timeline(flights: DataFrame, aircraft: DataFrame, focus: Focus, as_of, days: int = 90) -> DataFrame:
    rows = _flown(flights, aircraft, focus).where(F.col("flight_date") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    kind = F.when(F.col("route") == focus.route, "focus").when(F.col("route") == f"{focus.arr}-{focus.dep}", "reverse").otherwise("other")
    return rows.select("registration", "id", "route", "first_seen", "last_seen", kind.alias("kind")).orderBy("registration", "first_seen", "id")


def _focus(flights: DataFrame, aircraft: DataFrame, focus: Focus) -> DataFrame:
    return _flown(flights, aircraft, focus).where(F.col("route") == focus.route)


def dow_counts(flights: DataFrame, aircraft: DataFrame, focus: Focus) -> DataFrame:
    day = utc_weekday(F.col("first_seen"))
    return _focus(flights, aircraft, focus).groupBy("registration", day.alias("dow")).agg(F.count("*").alias("n")).withColumn("day", weekday_name(F.col("dow")))


def dow_heatmap(flights: DataFrame, aircraft: DataFrame, focus: Focus) -> DataFrame:
    counts = _intensity(dow_counts(flights, aircraft, focus))
    return counts.groupBy("registration").pivot("dow", list(range(7))).agg(F.first("intensity")).na.fill(0.0).select("registration", *(F.col(str(d)).alias(f"d{d}") for d in range(7)))


def cycle_gaps(flights: DataFrame, aircraft: DataFrame, focus: Focus) -> DataFrame:
    """Days between consecutive focus flights of a registration."""
    gap = F.datediff("flight_date", F.lag("flight_date").over(_in_order()))
    return _focus(flights, aircraft, focus).select("registration", gap.alias("gap")).where("gap IS NOT NULL")


def cycle_histogram(gaps: DataFrame) -> DataFrame:
    widest = gaps.agg(F.max("gap").alias("widest"))
    width = F.when(F.col("widest") <= 30, 1).when(F.col("widest") <= 60, 2).otherwise(5)
    rows = gaps.join(F.broadcast(widest.select(width.alias("width"))), how="cross")  # one row
    return rows.groupBy((F.floor(F.col("gap") / F.col("width")) * F.col("width")).cast("long").alias("bin"), "width").agg(F.count("*").alias("n"))


def cycle_summary(gaps: DataFrame) -> DataFrame:
    mean = gaps.groupBy("registration").agg(F.round(F.sum("gap") / F.count("*"), 1).alias("average"), F.count("*").alias("n"))
    a = F.col("average")
    return mean.withColumn("class", F.when(a <= 7, "week").when(a <= 14, "two weeks").when(a <= 21, "three weeks").otherwise("more"))


def route_transitions(flights: DataFrame, aircraft: DataFrame, focus: Focus, limit: int = 80) -> DataFrame:
    rows = _flown(flights, aircraft, focus).select(F.col("route").alias("from_route"), F.lead("route").over(_in_order()).alias("to_route")).where("to_route IS NOT NULL")
    return rows.groupBy("from_route", "to_route").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_route", "to_route").limit(limit)


def transition_probabilities(transitions: DataFrame) -> DataFrame:
    """Shares within the kept transitions of the same origin."""
    return transitions.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("from_route")), 6))


def route_affinity(flights: DataFrame, aircraft: DataFrame, focus: Focus, k: int = 20) -> DataFrame:
    rows = _flown(flights, aircraft, focus)
    top = rows.groupBy("route").agg(F.count("*").alias("t")).orderBy(F.desc("t"), "route").limit(k)
    counts = rows.join(F.broadcast(top), "route", "left_semi").groupBy("registration", "route").agg(F.count("*").alias("n"))  # top: k rows
    return _intensity(counts)


def _intensity(counts: DataFrame) -> DataFrame:
    """counts with n's share of the greatest n, which is one aggregate and gathers no rows."""
    return counts.withColumn("intensity", F.round(F.col("n") / counts.agg(F.max("n")).scalar(), 6))


def affinity_matrix(affinity: DataFrame) -> DataFrame:
    """A row per registration and a column per route of route_affinity, which has k of them at most."""
    routes = [r["route"] for r in affinity.select("route").distinct().orderBy("route").collect()]
    return affinity.groupBy("registration").pivot("route", routes).agg(F.first("intensity")).na.fill(0.0)


def preceding_routes(flights: DataFrame, aircraft: DataFrame, focus: Focus, steps: int = 3, per_step: int | None = None) -> DataFrame:
    """Routes flown 1 to `steps` flights before a focus flight; window look-backs instead of a self-join."""
    w = W.partitionBy("icao24").orderBy("first_seen", "id")
    rows = _flown(flights, aircraft, focus)
    before = F.array(*(F.struct(F.lit(s).alias("step"), F.lag("route", s).over(w).alias("earlier")) for s in range(1, steps + 1)))
    rows = rows.withColumn("before", before).where(F.col("route") == focus.route).select(F.explode("before").alias("b")).select("b.*").where("earlier IS NOT NULL")
    counts = rows.groupBy("step", "earlier").agg(F.count("*").alias("n"))
    if per_step:
        counts = counts.withColumn("nth", F.row_number().over(W.partitionBy("step").orderBy(F.desc("n"), "earlier"))).where(F.col("nth") <= per_step).drop("nth")
    return counts


def last_known_airport(flights: DataFrame, aircraft: DataFrame, focus: Focus) -> DataFrame:
    rows = _flown(flights, aircraft, focus).where("is_active")
    return rows.groupBy("registration").agg(F.max_by(F.struct(ARR, "last_seen"), F.struct("last_seen", "id")).alias("f")).select("registration", F.col(f"f.{ARR}").alias("airport"), "f.last_seen")


def focus_route_history(flights: DataFrame, aircraft: DataFrame, focus: Focus) -> DataFrame:
    """All flights of the focus route, reviewed or not, newest first."""
    rows = _flown(flights, aircraft, focus, reviewed=False).where(F.col("route") == focus.route)
    return rows.select("id", "registration", "callsign", "first_seen", "last_seen", "duration_minutes").orderBy(F.desc("first_seen"), "id")
