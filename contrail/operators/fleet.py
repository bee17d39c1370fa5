"""The fleet registry: discovery, refresh, retirement and comparison with outside registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.scalars import aircraft_needs_review, clean_code, strip
from contrail.operators.geo import captured
from contrail.operators.merge import merge, replace

SEEN_DAYS, LEAST_FLEET = 7, 50


def filter_fleet(states: DataFrame, aircraft: DataFrame, types: list[str] | None = None) -> DataFrame:
    """States of active aircraft, of the given types if there are any."""
    active = aircraft.where("is_active")
    if types:
        active = active.where(F.col("aircraft_type").isin(types))
    return states.join(active.select("icao24"), "icao24", "left_semi")


def clean_register(register: DataFrame) -> DataFrame:
    """Codes in one case, rows without hex code or registration dropped; row_no is the file's order."""
    out = register.select(
        "row_no",
        clean_code(F.col("icao24"), "lower").alias("icao24"),
        clean_code(F.col("registration")).alias("registration"),
        clean_code(F.col("typecode")).alias("aircraft_type"),
        clean_code(F.col("model"), "keep").alias("aircraft_subtype"),
        clean_code(F.col("operatoricao")).alias("operator"),
    )
    return out.where("icao24 IS NOT NULL AND registration IS NOT NULL")


def _first(rows: DataFrame, keys: list[str], first: bool = True) -> DataFrame:
    rest = F.struct(*(c for c in rows.columns if c not in keys))
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*keys).agg(pick(rest, "row_no").alias("r")).select(*keys, "r.*")


def airline_fleet(register: DataFrame, operator: str, prefixes: list[str]) -> DataFrame:
    """Aircraft of the operator, or of no operator and a registration prefix; the first row per hex code, with `rule`."""
    prefixed = F.lit(False)
    for p in prefixes:
        prefixed = prefixed | F.col("registration").startswith(p)
    rule = F.when(F.col("operator") == operator, "operator").when(F.col("operator").isNull() & prefixed, "prefix")
    return _first(clean_register(register).withColumn("rule", rule).where("rule IS NOT NULL"), ["icao24"]).drop("row_no", "operator")


def register_lookup(register: DataFrame, wanted: DataFrame) -> DataFrame:
    """Register rows of the wanted hex codes, later rows overwriting; reading ends where all have been found."""
    rows = clean_register(register).join(wanted.select("icao24").distinct(), "icao24", "left_semi")
    firsts = rows.groupBy("icao24").agg(F.min("row_no").alias("first"))
    total = wanted.agg(F.countDistinct("icao24").alias("wanted"))
    stop = firsts.agg(F.count("*").alias("found"), F.max("first").alias("last")).crossJoin(total)  # one row each
    until = stop.select(F.when(F.col("found") == F.col("wanted"), F.col("last")).alias("until"))
    kept = rows.join(F.broadcast(until), F.col("until").isNull() | (F.col("row_no") <= F.col("until"))).drop("until")
    return _first(kept, ["icao24"], first=False).drop("row_no", "operator")


def discover_aircraft(states: DataFrame, aircraft: DataFrame, register: DataFrame, types: DataFrame) -> DataFrame:
    """Aircraft seen live that aren't active in the fleet, enriched from the register; by type look-ups only where it lacks them."""
    seen = states.select("icao24").distinct().join(aircraft.where("is_active").select("icao24"), "icao24", "left_anti")
    found = register_lookup(register, seen).withColumn("listed", F.lit(True))
    t = types.select("icao24", F.col("aircraft_type").alias("t"), F.col("aircraft_subtype").alias("s"))
    rows = seen.join(found, "icao24", "left").join(t, "icao24", "left")
    filled = lambda own, other: F.when(F.col("listed"), F.col(own)).otherwise(F.col(other)).alias(own)
    rows = rows.select("icao24", F.coalesce("registration", F.upper("icao24")).alias("registration"), filled("aircraft_type", "t"), filled("aircraft_subtype", "s"))
    return rows.withColumn("needs_review", aircraft_needs_review(F.col("registration"), F.col("aircraft_type"), F.col("icao24")))


def seen_lately(positions: DataFrame, as_of, days: int = SEEN_DAYS) -> DataFrame:
    return captured(positions, F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")).select("icao24").distinct()


def reactivate_seen(aircraft: DataFrame, positions: DataFrame, as_of) -> DataFrame:
    seen = seen_lately(positions, as_of).withColumn("is_active", F.lit(True))
    return merge(aircraft, seen, ["icao24"], {"is_active": replace}, insert=False)


def refresh_aircraft(aircraft: DataFrame, register: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Active aircraft that the register lists: blanks filled from it, or by look-ups where both lack the type.

    A placeholder registration is only replaced if it equals the lower-case hex code; the review flag stays.
    """
    new = register.select("icao24", "registration", "aircraft_type", "aircraft_subtype")
    if lookups is not None:
        known = aircraft.select("icao24", F.col("aircraft_type").alias("own"))
        found = lookups.select("icao24", F.col("aircraft_type").alias("t"), F.col("aircraft_subtype").alias("s"))
        new = new.join(known, "icao24", "left").join(found, "icao24", "left")
        lacking = F.col("own").isNull() & F.col("aircraft_type").isNull()
        new = new.select("icao24", "registration", F.when(lacking, F.col("t")).otherwise(F.col("aircraft_type")).alias("aircraft_type"), F.when(lacking, F.coalesce("aircraft_subtype", "s")).otherwise(F.col("aircraft_subtype")).alias("aircraft_subtype"))
    filled = lambda old, value: F.coalesce(F.nullif(old, F.lit("")), value)
    named = lambda old, value: F.coalesce(F.nullif(old, F.col("t.icao24")), value, old)
    return merge(aircraft, new, ["icao24"], {"registration": named, "aircraft_type": filled, "aircraft_subtype": filled}, insert=False, when=lambda t, s: t("is_active"))


def retire_missing(aircraft: DataFrame, register: DataFrame, positions: DataFrame, as_of) -> DataFrame:
    """Active aircraft that neither the register nor the last week's positions know are retired."""
    gone = aircraft.where("is_active").select("icao24").join(register.select("icao24"), "icao24", "left_anti").join(seen_lately(positions, as_of), "icao24", "left_anti")
    gone = gone.select("icao24", F.lit(False).alias("is_active"), F.to_date(F.lit(as_of)).alias("last_seen_date"))
    target = aircraft if "last_seen_date" in aircraft.columns else aircraft.withColumn("last_seen_date", F.lit(None).cast("date"))
    return merge(target, gone, ["icao24"], {"is_active": replace, "last_seen_date": replace}, insert=False)


def fleet_sanity_guard(register_fleet: DataFrame, least: int = LEAST_FLEET) -> DataFrame:
    """Refuses a register that is too small to be whole. It counts at once, up to `least` rows, as a guard must."""
    found = register_fleet.limit(least).count()
    if found < least:
        raise ValueError(f"the register lists {found} aircraft; fewer than {least} aren't trusted")
    return register_fleet


def compare_fleets(external: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Per registration of either side: `side`, and whether types differ, can be filled, or the aircraft is inactive."""
    ours = aircraft.select(F.upper(strip(F.coalesce("registration", F.lit("")))).alias("registration"), F.nullif(F.upper(strip(F.col("aircraft_type"))), F.lit("")).alias("our_type"), "is_active", "icao24").where("registration <> ''")
    ours = ours.groupBy("registration").agg(F.max_by(F.struct("our_type", "is_active", "icao24"), "icao24").alias("o")).select("registration", "o.*")
    theirs = external.select("registration", F.col("aircraft_type").alias("their_type"), F.lit(True).alias("theirs"))
    rows = theirs.join(ours, "registration", "full_outer")
    both = F.coalesce("theirs", F.lit(False)) & F.col("icao24").isNotNull()
    flag = lambda c: both & F.coalesce(c, F.lit(False))
    return rows.select(
        "registration", "icao24", "their_type", "our_type",
        F.when(both, "both").when(F.col("icao24").isNull(), "external").otherwise("fleet").alias("side"),
        flag(F.col("their_type") != F.col("our_type")).alias("mismatch"),
        flag(F.col("their_type").isNotNull() & F.col("our_type").isNull()).alias("fillable"),
        flag(~F.col("is_active")).alias("reactivate"),
    )


def fleet_totals(diff: DataFrame) -> DataFrame:
    """compare_fleets in one row: aircraft of each side, in both and on one side only, and what would be changed."""
    external, ours = F.col("side") != "fleet", F.col("side") != "external"
    counts = {"external": external, "fleet": ours, "both": external & ours, "only_external": ~ours, "only_fleet": ~external, "mismatches": F.col("mismatch"), "fillable": F.col("fillable"), "reactivations": F.col("reactivate")}
    return diff.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def apply_fleet_fixes(aircraft: DataFrame, diff: DataFrame) -> DataFrame:
    src = diff.where("fillable OR reactivate").select("icao24", "fillable", "reactivate", F.col("their_type").alias("aircraft_type"), F.lit(True).alias("is_active"))
    fill = lambda old, new: F.when(F.col("s.fillable"), F.coalesce(F.nullif(old, F.lit("")), new)).otherwise(old)
    wake = lambda old, new: old | F.col("s.reactivate")
    return merge(aircraft, src, ["icao24"], {"aircraft_type": fill, "is_active": wake}, insert=False)


def rebuild_fleet(external: DataFrame, register: DataFrame, prefix: str = "D-A") -> DataFrame:
    """External aircraft of the prefix with their register rows; `skipped` marks those the register lacks."""
    last = _first(clean_register(register), ["registration"], first=False)
    last = last.select("registration", "icao24", F.col("aircraft_type").alias("r_type"), "aircraft_subtype", F.lit(True).alias("listed"))
    rows = external.where(F.col("registration").startswith(prefix)).join(last, "registration", "left")
    out = rows.select("registration", "icao24", F.coalesce("aircraft_type", "r_type").alias("aircraft_type"), "aircraft_subtype", F.col("listed").isNull().alias("skipped"))
    return out.withColumn("needs_review", aircraft_needs_review(F.col("registration"), F.col("aircraft_type"), F.col("icao24")))


def backfill_review_flag(aircraft: DataFrame) -> DataFrame:
    flagged = aircraft_needs_review(F.col("registration"), F.col("aircraft_type"), F.col("icao24"))
    return aircraft.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | flagged)
