"""Key-based merges. Parquet has no MERGE, so each yields the new table by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["icao24", "first_seen"]


def merge(target: DataFrame, src: DataFrame, keys: list[str], update: dict[str, Callable[[Column, Column], Column]], insert: bool, when: Callable | None = None) -> DataFrame:
    """target with rows of src: matched rows take update(old, new) by column, others are inserted if asked for.

    src has at most one row a key.
    """
    old, new = target.select(F.struct(*target.columns).alias("t"), *keys), src.select(F.struct(*src.columns).alias("s"), *keys)
    rows = old.join(new, keys, "full_outer" if insert else "left")
    matched = F.col("t").isNotNull() & F.col("s").isNotNull()
    if when is not None:
        matched = matched & when(lambda c: F.col(f"t.{c}"), lambda c: F.col(f"s.{c}"))
    out = []
    for c in target.columns:
        kept = F.col(f"t.{c}")
        changed = update[c](kept, F.col(f"s.{c}")) if c in update and c in src.columns else kept
        value = F.when(F.coalesce(matched, F.lit(False)), changed).otherwise(kept)
        if insert:
            fresh = F.col(f"s.{c}") if c in src.columns else F.lit(None)
            value = F.when(F.col("t").isNull(), fresh).otherwise(value)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return rows.select(*out)


def one_row_a_key(rows: DataFrame, keys: list[str], order: str = "last_seen") -> DataFrame:
    """Of the rows of each key that of the greatest `order`; ties are broken by the other columns, so reruns agree."""
    rest = [c for c in rows.columns if c not in keys]
    first = [order, *(c for c in rest if c != order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*first)).alias("row")).select(*(c if c in keys else F.col(f"row.{c}") for c in rows.columns))


def replace(_old: Column, new: Column) -> Column:
    return new


def fill(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def unless_null(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def unless_blank(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(new, F.lit("")), old)


def insert_positions(existing: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """The rows of batch to append: new (icao24, captured_at), the first of each in the batch."""
    keys = ["icao24", "captured_at"]
    if order:
        batch = batch.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("nth = 1").drop("nth", order)
    else:
        batch = batch.dropDuplicates(keys)
    return batch.join(existing.select(*keys), keys, "left_anti")


def upsert_flights(target: DataFrame, src: DataFrame) -> DataFrame:
    """Conflicts replace callsign, arrival, end and review; the departure stays."""
    changed = dict.fromkeys(("callsign", "arrival_airport_icao", "last_seen", "needs_review"), replace)
    return merge(target, src, KEY, changed, insert=True)


def update_open_flights(target: DataFrame, src: DataFrame) -> DataFrame:
    """Only flights without arrival change; an update without arrival extends them."""
    given = F.col("s.arrival_airport_icao").isNotNull()
    changed = {
        "arrival_airport_icao": unless_null,
        "last_seen": replace,
        "callsign": unless_null,
        "needs_review": lambda old, new: F.when(given, new).otherwise(old),
    }
    return merge(target, src, KEY, changed, insert=False, when=lambda t, s: t("arrival_airport_icao").isNull())


def fill_departure(target: DataFrame, src: DataFrame) -> DataFrame:
    return merge(target, src, KEY, {"departure_airport_icao": fill}, insert=False)


def changed_departures(target: DataFrame, src: DataFrame) -> DataFrame:
    """How many flights fill_departure changes."""
    given = src.where("departure_airport_icao IS NOT NULL").select(*KEY)
    return target.where("departure_airport_icao IS NULL").join(given, KEY, "left_semi").agg(F.count("*").alias("changed"))


def upsert_aircraft(target: DataFrame, src: DataFrame) -> DataFrame:
    names = ("registration", "aircraft_type", "aircraft_subtype", "needs_review", "is_active")
    return merge(target, src.withColumn("is_active", F.lit(True)), ["icao24"], dict.fromkeys(names, replace), insert=True)


def merge_flight_actions(flights: DataFrame, opened: DataFrame, updates: DataFrame) -> DataFrame:
    """Applies openings (upserts), then guarded updates; doing it twice changes nothing more."""
    return update_open_flights(upsert_flights(flights, opened), updates)


def compare_flight_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per aircraft: distinct flights in a, in b, in both, only in one, and a verdict."""
    keys = ["icao24", "first_seen", "last_seen", "departure_airport_icao", "arrival_airport_icao"]
    sides = a.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(*keys, F.lit(0), F.lit(1)))
    flights = sides.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = flights.groupBy("icao24").agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_a"), F.sum(F.col("b") * (1 - F.col("a"))).alias("only_b")
    )
    return out.withColumn("verdict", F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "OK").otherwise("MISMATCH"))


def apply_review(aircraft: DataFrame, flights: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aircraft and flights after the edits (see sources.payloads.load_review_edits); pending ones change nothing."""
    acting = edits.where(F.col("action").isin("UPDATE", "DISMISS"))
    editing = F.col("s.action") == "UPDATE"
    edit = lambda old, new: F.when(editing, unless_blank(old, new)).otherwise(old)
    clear = lambda old, new: F.lit(False)
    planes = acting.where("kind = 'aircraft'").select(F.col("key").alias("icao24"), "action", "registration", F.col("type").alias("aircraft_type"), F.col("subtype").alias("aircraft_subtype"), F.lit(False).alias("needs_review"))
    trips = acting.where("kind = 'flight'").select(F.col("key").cast("long").alias("id"), "action", F.col("dep").alias("departure_airport_icao"), F.col("arr").alias("arrival_airport_icao"), F.lit(False).alias("needs_review"))
    aircraft = merge(aircraft, planes, ["icao24"], {"registration": edit, "aircraft_type": edit, "aircraft_subtype": edit, "needs_review": clear}, insert=False)
    flights = merge(flights, trips, ["id"], {"departure_airport_icao": edit, "arrival_airport_icao": edit, "needs_review": clear}, insert=False)
    return aircraft, flights


def expire_positions(positions: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The positions to keep, as rows. sources.payloads.expire_folders does it to a table of daily folders without reading them."""
    return positions.where(F.col("captured_at") >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def insert_new_rows(target: DataFrame, rows: DataFrame, keys: list[str], parent: DataFrame | None = None, parent_key: str = "icao24") -> DataFrame:
    """The rows with new keys whose parent exists."""
    new = rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return new if parent is None else new.join(parent.select(parent_key), parent_key, "left_semi")


def delete_unreferenced(aircraft: DataFrame, doomed: DataFrame, flights: DataFrame) -> DataFrame:
    """aircraft without the doomed ones to which no flight refers."""
    gone = doomed.select("icao24").join(flights.select("icao24"), "icao24", "left_anti")
    return aircraft.join(gone, "icao24", "left_anti")
