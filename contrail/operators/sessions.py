"""Sessions of positions and what the flight detector needs to know of each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrail.config import DetectorConfig
from contrail.functions.scalars import clean_code, is_on_ground
from contrail.operators.geo import nearest_airport, nearest_airports

POINT = ("captured_at", "latitude", "longitude")
#: Positions that a task of session_features sorts: its windows hold some kilobytes a row.
TASK_ROWS = 1 << 17


def by_aircraft() -> W:
    return W.partitionBy("icao24").orderBy("captured_at")


def by_session() -> W:
    return W.partitionBy("icao24", "session_no").orderBy("captured_at")


def with_ground(positions: DataFrame, cfg: DetectorConfig) -> DataFrame:
    return positions.withColumn("ground", is_on_ground(F.col("on_ground"), F.col("velocity_ms"), F.col("altitude_m"), cfg))


def split_sessions(positions: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """positions with `session_no` (from 0): a new session begins where the gap is strictly greater than allowed."""
    gap = F.unix_micros("captured_at") - F.unix_micros(F.lag("captured_at").over(by_aircraft()))
    breaks = F.coalesce((gap > cfg.gap_seconds * 1_000_000).cast("int"), F.lit(0))
    return positions.withColumn("breaks", breaks).withColumn("session_no", F.sum("breaks").over(by_aircraft()).cast("int")).drop("breaks")


def session_callsign(sessions: DataFrame) -> DataFrame:
    cs = clean_code(F.col("callsign"), "keep")
    return sessions.groupBy("icao24", "session_no").agg(F.min_by(cs, F.when(cs.isNotNull(), F.col("captured_at"))).alias("session_callsign"))


def ground_transitions(sessions: DataFrame) -> DataFrame:
    """Rows with `edge` ('departure', 'arrival' or null) and `previous`, the last row before with a known ground flag.

    Needs session_no and ground; rows of unknown ground are no edges and don't part two that are.
    """
    before = by_session().rowsBetween(W.unboundedPreceding, -1)
    known = F.when(F.col("ground").isNotNull(), F.struct(*POINT, "ground", "callsign"))
    rows = sessions.withColumn("previous", F.last(known, ignorenulls=True).over(before))
    edge = F.when(F.col("previous.ground") & ~F.col("ground"), "departure").when(~F.col("previous.ground") & F.col("ground"), "arrival")
    return rows.withColumn("edge", edge)


def first_departure(edges: DataFrame) -> DataFrame:
    """The last row on the ground before each session's first take-off."""
    hit = F.when(F.col("edge") == "departure", F.col("captured_at"))
    found = edges.groupBy("icao24", "session_no").agg(F.min_by(F.struct("previous.captured_at", "previous.latitude", "previous.longitude"), hit).alias("d"))
    return found.where("d IS NOT NULL").select("icao24", "session_no", "d.*")


def first_arrival_after(edges: DataFrame, after: DataFrame) -> DataFrame:
    """Each session's first landing later than `after` (icao24, session_no, after)."""
    rows = edges.where("edge = 'arrival'").join(after, ["icao24", "session_no"]).where("captured_at > after")
    return rows.groupBy("icao24", "session_no").agg(F.min_by(F.struct(*POINT), "captured_at").alias("a")).select("icao24", "session_no", "a.*")


def landing_sign(window: W, rows: int, cfg: DetectorConfig):
    """'ground', 'low' (low and descending or frozen: a landing if an airport is near) or null, of the rows up to this one."""
    frame = window.rowsBetween(-(rows - 1), 0)
    altitude = F.col("altitude_m")
    first, last = F.first("altitude_m", ignorenulls=True).over(frame), F.last("altitude_m", ignorenulls=True).over(frame)
    descending = (F.count("altitude_m").over(frame) >= 2) & (last < first)
    frozen = F.count(F.lit(1)).over(frame) >= 3
    for k in (1, 2):
        for c in ("latitude", "longitude", "altitude_m"):
            frozen = frozen & F.lag(c, k).over(window).eqNullSafe(F.col(c))
    low = (altitude < cfg.proximity_altitude_m) & (descending | frozen)
    return F.when(F.col("ground"), "ground").when(low, "low")


def detect_landing(sessions: DataFrame, airports: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Where each session's tail shows a landing: its last row."""
    rows = sessions.withColumn("sign", landing_sign(by_session(), cfg.tail_rows, cfg))
    last = rows.groupBy("icao24", "session_no").agg(F.max_by(F.struct(*POINT, "sign"), "captured_at").alias("p")).select("icao24", "session_no", "p.*")
    near = nearest_airport(last.where("sign IS NOT NULL"), airports, cfg.proximity_radius_km)
    return near.where("sign = 'ground' OR airport IS NOT NULL").select("icao24", "session_no", *POINT, "sign")


def departure_sign(cfg: DetectorConfig):
    """Whether a session's first rows show a departure; an aggregate over rows with `nth` in the session."""
    head = F.col("nth") <= cfg.head_rows
    high = F.when(head & F.col("altitude_m").isNotNull(), F.col("captured_at"))
    first, last = F.min_by("altitude_m", high), F.max_by("altitude_m", high)
    start = F.min_by("altitude_m", "captured_at")
    climbing = (F.count(high) >= 2) & (last > first) & (start < cfg.missed_departure_altitude_m)
    return F.coalesce(F.min_by("ground", "captured_at"), F.lit(False)) | F.coalesce(climbing, F.lit(False))


def detect_departure(sessions: DataFrame, cfg: DetectorConfig) -> DataFrame:
    rows = sessions.withColumn("nth", F.row_number().over(by_session()))
    found = rows.groupBy("icao24", "session_no").agg(departure_sign(cfg).alias("departs"), F.min_by(F.struct(*POINT), "captured_at").alias("p"))
    return found.where("departs").select("icao24", "session_no", "p.*")


def tasks_for(positions: DataFrame) -> int:
    """How many tasks positions are dealt to, by aircraft, so that each has about TASK_ROWS; 0: one could take them all."""
    rows = positions.count()
    return max(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS)) if rows > TASK_ROWS else 0


def session_features(positions: DataFrame, airports: DataFrame, cfg: DetectorConfig, since=None, tasks: int | None = None) -> DataFrame:
    """A row per session with all that the session walk asks for, airports resolved.

    Positions are counted, then read and shuffled once, by aircraft, which every window and aggregate over them reuses.
    since: sessions are made of later rows only, while the rows just before a session may be older.
    tasks: what tasks_for gives, where it is known; 0 leaves positions as they are dealt, for large tables in buckets.
    """
    tasks = tasks_for(positions) if tasks is None else tasks
    if tasks:
        positions = positions.repartition(tasks, "icao24")
    rows = with_ground(positions, cfg).withColumn("sign", landing_sign(by_aircraft(), cfg.lookback_rows, cfg))
    rows = rows.withColumn("before", F.lag(F.struct(*POINT, "sign")).over(by_aircraft())).drop("sign")
    if since is not None:
        rows = rows.where(F.col("captured_at") >= F.lit(since))
    rows = ground_transitions(split_sessions(rows, cfg))
    rows = rows.withColumns({"nth": F.row_number().over(by_session()), "tail": landing_sign(by_session(), cfg.tail_rows, cfg), "cs": clean_code(F.col("callsign"), "keep")})
    takes_off, lands, ts = F.col("edge") == "departure", F.col("edge") == "arrival", F.col("captured_at")
    whole = by_session().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("d_at", F.min(F.when(takes_off, F.col("previous.captured_at"))).over(whole))
    point = F.struct(*POINT)
    sessions = rows.groupBy("icao24", "session_no").agg(
        F.count("*").alias("n"),
        F.min_by("ground", "captured_at").alias("starts"),
        F.min_by(F.col("cs"), F.when(F.col("cs").isNotNull(), ts)).alias("callsign"),
        F.min_by(F.col("cs"), F.when(F.col("cs").isNotNull() & (ts >= F.col("d_at")), ts)).alias("d_callsign"),
        F.min_by(point, "captured_at").alias("first"),
        F.max_by(point, "captured_at").alias("last"),
        F.min_by(F.struct("previous.captured_at", "previous.latitude", "previous.longitude"), F.when(takes_off, ts)).alias("d"),
        F.min_by(point, F.when(lands & (ts > F.col("d_at")), ts)).alias("da"),
        F.min_by(point, F.when(lands, ts)).alias("fa"),
        F.max_by("tail", "captured_at").alias("tail"),
        F.min_by("before", "captured_at").alias("before"),
        departure_sign(cfg).alias("departs"),
    )
    names = ("first", "last", "d", "da", "fa", "before")
    out = nearest_airports(sessions, airports, cfg.airport_radius_km, {f"{n}_airport": (F.col(f"{n}.latitude"), F.col(f"{n}.longitude")) for n in names})
    close = lambda n: F.coalesce(F.col(f"{n}_airport.airport_km") <= cfg.proximity_radius_km, F.lit(False))
    lands_at = lambda sign, n: F.coalesce((sign == "ground") | ((sign == "low") & close(n)), F.lit(False))
    return out.select(
        "icao24", "session_no", "n", "starts", "callsign", F.coalesce("d_callsign", "callsign").alias("d_callsign"), "departs",
        *(F.col(f"{n}.captured_at").alias(f"{n}_at") for n in names),
        *(F.col(f"{n}_airport.airport").alias(f"{n}_airport") for n in names),
        lands_at(F.col("tail"), "last").alias("tail_lands"),
        lands_at(F.col("before.sign"), "before").alias("before_lands"),
    )
