"""Reports for a dashboard. What the time is, is always a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrail.functions.scalars import route_label
from contrail.operators.geo import captured

RUN_TYPES = ("state_poller", "flight_detector", "fleet_discovery", "fleet_refresh")
DEP, ARR = "departure_airport_icao", "arrival_airport_icao"


def _day(as_of, back: int = 0):
    return F.date_sub(F.to_date(F.lit(as_of)), back)


def _clean(flights: DataFrame) -> DataFrame:
    return flights.where(~F.col("needs_review"))


def fleet_counts(aircraft: DataFrame) -> DataFrame:
    return aircraft.agg(F.count_if("is_active").alias("active"), F.count("*").alias("total"), F.count_if(~F.col("is_active")).alias("retired"))


def flight_counts(flights: DataFrame, as_of) -> DataFrame:
    good = F.col(DEP).isNotNull() & ~F.col("needs_review")
    return flights.agg(
        F.count_if(good & (F.col("flight_date") == _day(as_of))).alias("today"), F.count_if(good & (F.col("flight_date") >= _day(as_of, 7))).alias("week"),
        F.count_if(good).alias("all"), F.count_if(F.col(ARR).isNull()).alias("pending"),
    )


def recent_errors(runs: DataFrame, as_of, hours: int = 48) -> DataFrame:
    return runs.where((F.col("status") != "ok") & (F.col("started_at") >= F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS"))).orderBy(F.desc("started_at"), "id")


def airborne_now(positions: DataFrame) -> DataFrame:
    """Aircraft in the air at the last captured moment; the flag is the reported one."""
    last = positions.agg(F.max("captured_at")).scalar()
    return positions.where((F.col("captured_at") == last) & ~F.col("on_ground")).agg(F.count_distinct("icao24").alias("airborne"))


def poll_age_minutes(positions: DataFrame, as_of) -> DataFrame:
    seconds = (F.unix_micros(F.lit(as_of)) - F.unix_micros(F.max("captured_at"))) / 1_000_000
    return positions.agg(F.round(seconds / 60).cast("long").alias("age_minutes"))


def last_run_per_type(runs: DataFrame) -> DataFrame:
    spark, rest = runs.sparkSession, [c for c in runs.columns if c != "run_type"]
    last = runs.groupBy("run_type").agg(F.max_by(F.struct(*rest), F.struct("started_at", "id")).alias("r"))
    return spark.createDataFrame([(t,) for t in RUN_TYPES], "run_type string").join(last, "run_type", "left").select("run_type", "r.*")


def health_status(last_runs: DataFrame, poll_age: DataFrame, as_of) -> DataFrame:
    """green, amber or red per job."""
    ok, ran = F.coalesce(F.col("status") == "ok", F.lit(False)), F.col("started_at").isNotNull()
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("started_at")) / 1_000_000
    fresh = lambda s: F.coalesce(age < s, F.lit(False))
    rows = last_runs.join(F.broadcast(poll_age), how="cross")  # one row
    polled = F.coalesce(F.col("age_minutes") <= 10, F.lit(True))
    status = (
        F.when(F.col("run_type") == "state_poller", F.when(ok & polled, "green").when(ran, "amber").otherwise("red"))
        .when(F.col("run_type") == "flight_detector", F.when(ok, "green").otherwise("red"))
        .when(F.col("run_type") == "fleet_discovery", F.when(ok & fresh(7 * 3600), "green").when(~fresh(7 * 3600), "amber").otherwise("red"))
        .otherwise(F.when(ok & fresh(8 * 86400), "green").when(~fresh(8 * 86400), "amber").otherwise("red"))
    )
    return rows.select("run_type", status.alias("health"))


def aircraft_by_type(aircraft: DataFrame) -> DataFrame:
    return aircraft.where("is_active").groupBy(F.coalesce("aircraft_type", F.lit("unknown")).alias("aircraft_type")).agg(F.count("*").alias("n"))


def flew_by_type(flights: DataFrame, aircraft: DataFrame, as_of, days: int = 7) -> DataFrame:
    recent = _clean(flights).where(F.col("flight_date") >= _day(as_of, days)).select("icao24")
    return aircraft_by_type(aircraft.join(recent, "icao24", "left_semi")).withColumnRenamed("n", "flew")


def type_overlay(flights: DataFrame, aircraft: DataFrame, as_of) -> DataFrame:
    rows = aircraft_by_type(aircraft).join(flew_by_type(flights, aircraft, as_of), "aircraft_type", "left").na.fill(0, ["flew"])
    return rows.withColumn("share", F.round(F.col("flew") / F.col("n"), 6))


def top_routes(flights: DataFrame, as_of, days: int = 30, k: int = 20) -> DataFrame:
    rows = _clean(flights).where(F.col(DEP).isNotNull() & F.col(ARR).isNotNull() & (F.col("flight_date") >= _day(as_of, days)))
    return rows.groupBy(DEP, ARR).agg(F.count("*").alias("n")).orderBy(F.desc("n"), DEP, ARR).limit(k)


def flights_per_day(flights: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Flights and distinct callsigns per day."""
    rows = _clean(flights).where(F.col("flight_date") >= _day(as_of, days - 1))
    per_day = rows.groupBy("flight_date").agg(F.count("*").alias("n_flights"))
    named = rows.where(F.trim(F.coalesce("callsign", F.lit(""))) != "").groupBy("flight_date").agg(F.count_distinct("callsign").alias("n_callsigns"))
    return per_day.join(named, "flight_date", "left").na.fill(0, ["n_callsigns"])


def fleet_list(aircraft: DataFrame, flights: DataFrame, positions: DataFrame, as_of) -> DataFrame:
    per = flights.groupBy("icao24").agg(F.count("*").alias("total_flights"), F.count_if(F.col("flight_date") >= _day(as_of, 7)).alias("flights_7d"), F.max("flight_date").alias("last_flight_date"))
    live = captured(positions, F.lit(as_of) - F.expr("INTERVAL 5 MINUTES")).select("icao24").distinct().withColumn("currently_tracking", F.lit(True))
    return aircraft.join(per, "icao24", "left").join(live, "icao24", "left").na.fill(0, ["total_flights", "flights_7d"]).na.fill(False, ["currently_tracking"])


def fleet_filter_sort(fleet: DataFrame, review: bool = False, status: str | None = None, aircraft_type: str | None = None, q: str = "", sort: str = "registration", ascending: bool = True) -> DataFrame:
    if review:
        fleet = fleet.where("needs_review")
    if status:
        fleet = fleet.where({"active": "is_active", "retired": "NOT is_active", "tracking": "currently_tracking"}[status])
    if aircraft_type:
        fleet = fleet.where(F.col("aircraft_type") == aircraft_type)
    if q:
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("null")) for c in ("registration", "icao24", "aircraft_type", "aircraft_subtype"))))
        fleet = fleet.where(hay.contains(q.lower()))
    key = F.col(sort)
    if dict(fleet.dtypes)[sort] == "string":
        key = F.coalesce(key, F.lit(""))
    return fleet.orderBy(key.asc() if ascending else key.desc(), "icao24")


def distinct_types(aircraft: DataFrame) -> DataFrame:
    return aircraft.where("aircraft_type IS NOT NULL").select("aircraft_type").distinct().orderBy("aircraft_type")


def aircraft_totals(flights: DataFrame, as_of) -> DataFrame:
    since = lambda d: F.count_if(F.col("flight_date") >= _day(as_of, d))
    return flights.groupBy("icao24").agg(F.count("*").alias("total"), since(7).alias("last_7d"), since(30).alias("last_30d"))


def aircraft_last_flights(flights: DataFrame, k: int = 100) -> DataFrame:
    rows = flights.where(F.col(DEP).isNotNull()).withColumn("nth", F.row_number().over(W.partitionBy("icao24").orderBy(F.desc("first_seen"), "id")))
    return rows.where(F.col("nth") <= k).select("icao24", "nth", "id", route_label(F.col(DEP), F.col(ARR)).alias("route"), F.col(ARR).isNull().alias("pending"))


def aircraft_top_routes(flights: DataFrame, k: int = 20) -> DataFrame:
    rows = flights.where(F.col(DEP).isNotNull() & F.col(ARR).isNotNull()).groupBy("icao24", route_label(F.col(DEP), F.col(ARR)).alias("route")).agg(F.count("*").alias("n"))
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("icao24").orderBy(F.desc("n"), "route"))).where(F.col("nth") <= k)


def aircraft_per_day(flights: DataFrame, as_of, days: int = 30) -> DataFrame:
    return flights.where(F.col("flight_date") >= _day(as_of, days - 1)).groupBy("icao24", "flight_date").agg(F.count("*").alias("n"))


def flights_page(flights: DataFrame, page: int = 1, per_page: int = 50, icao24: str = "", callsign: str = "", dep: str = "", arr: str = "", start=None, end=None, review: bool | None = None) -> DataFrame:
    """One page of the newest flights, with the total and the number of pages in each row."""
    per_page = min(max(1, per_page), 200)
    for name, value in (("icao24", icao24), ("callsign", callsign)):
        if value:
            flights = flights.where(F.lower(name).contains(value.lower()))
    for name, value in ((DEP, dep), (ARR, arr)):
        if value:
            flights = flights.where(F.col(name) == value.upper())
    if start is not None:
        flights = flights.where(F.col("flight_date") >= F.to_date(F.lit(start)))
    if end is not None:
        flights = flights.where(F.col("flight_date") <= F.to_date(F.lit(end)))
    if review is not None:
        flights = flights.where(F.col("needs_review") == review)
    total = flights.agg(F.count("*")).scalar()
    rows = flights.orderBy(F.desc("first_seen"), "id").offset((page - 1) * per_page).limit(per_page)
    return rows.withColumns({"total": total, "pages": F.ceil(total / per_page).cast("long")})


def review_aircraft(aircraft: DataFrame) -> DataFrame:
    return aircraft.where("needs_review").orderBy("icao24")


def review_flights(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    return flights.where("needs_review").join(aircraft.select("icao24", "registration"), "icao24").orderBy(F.desc("first_seen"), "id")
