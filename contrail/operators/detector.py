"""Flights from sessions: the walk over an aircraft's sessions, replays, stale and back-filled flights."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrail.config import DetectorConfig
from contrail.functions.scalars import dep_equals_arr
from contrail.operators import merge
from contrail.operators.geo import captured, last_completed_flight, latest_position, nearest_airport, nearest_airports, open_flights
from contrail.operators.sessions import session_features, tasks_for, with_ground
from contrail.shared import stage

FLIGHT = "icao24 string, callsign string, departure_airport_icao string, arrival_airport_icao string, first_seen long, last_seen long, needs_review boolean, path string"
UNKNOWN = "UNKN"


class Walk:
    """The state of one aircraft's walk: the flight in the air, if any, and the flights it has written. Times are epoch microseconds."""

    def __init__(self, cfg: DetectorConfig, stored_open: dict | None, completed: dict | None, replay: bool):
        self.cfg, self.completed, self.replay = cfg, completed, replay
        self.written: dict = {}
        self.flying = None
        if stored_open:
            self.written[stored_open["first_seen"]] = stored_open | {"path": ""}
            self.flying = stored_open | {"callsign": (stored_open["callsign"] or "").strip() or None}

    def open(self, case: str, callsign, dep, at, until, review: bool) -> None:
        kept = self.written.get(at)
        dep_stored = kept["departure_airport_icao"] if kept else dep
        self.written[at] = {"callsign": callsign, "departure_airport_icao": dep_stored, "arrival_airport_icao": None, "first_seen": at, "last_seen": until, "needs_review": review, "path": case}
        self.flying = {"first_seen": at, "callsign": callsign, "departure_airport_icao": dep}

    def extend(self, case: str, until, callsign, arr=None, review: bool = False) -> None:
        row = self.written[self.flying["first_seen"]]
        if row["arrival_airport_icao"] is None:
            row["last_seen"], row["callsign"] = until, callsign or row["callsign"]
            row["path"] += case
            if arr is not None:
                row["arrival_airport_icao"], row["needs_review"] = arr, review

    def close(self, case: str, at, arr, callsign, review: bool | None = None) -> None:
        """Ends the flight for the walk; without an airport the stored row stays open."""
        same = arr is not None and arr == self.flying["departure_airport_icao"]
        self.extend(case, at, callsign, arr, same if review is None else review or same)
        if self.replay:
            self.completed = {"last_seen": at, "arrival_airport_icao": arr}
        self.flying = None

    def take_off(self, s, callsign) -> None:
        """Opens at the session's first take-off and closes at the next landing in it."""
        if s.d_at is not None:
            self.open("D", callsign, s.d_airport, s.d_at, s.last_at, False)
            if s.da_at is not None:
                self.close("a", s.da_at, s.da_airport, callsign)

    def missed_departure(self, s) -> None:
        dep = s.first_airport if s.departs else None
        review = dep is None
        if dep is None and self.completed and s.first_at - self.completed["last_seen"] <= self.cfg.missed_departure_max_gap_h * 3_600_000_000:
            dep = (self.completed["arrival_airport_icao"] or "").strip() or None
            review = dep is None or dep == UNKNOWN
        self.open("2", s.callsign, dep, s.first_at, s.last_at, review)
        if s.fa_at is not None:
            self.close("a", s.fa_at, s.fa_airport, s.callsign, review)

    def on_session(self, s, previous) -> bool:
        """Whether the session was walked; a session that a completed flight covers is not."""
        if self.flying and previous is not None and previous.tail_lands:
            self.close("e", previous.last_at, previous.last_airport, self.flying["callsign"])
        if not self.flying:
            if not self.replay and self.completed and self.completed["last_seen"] >= s.first_at:
                return False
            if s.starts is True:
                self.take_off(s, s.callsign)
            elif s.starts is False:
                self.missed_departure(s)
            return True
        own = self.flying["callsign"]
        if s.starts is True:
            landed = ("4", s.before_at, s.before_airport) if s.before_lands else ("3", s.first_at, s.first_airport)
            self.close(*landed, s.callsign or own)
            self.take_off(s, s.d_callsign)
        elif s.starts is False and (own is None or s.callsign is None or own == s.callsign):
            self.extend("5", s.last_at, s.callsign or own)
            if s.fa_at is not None:
                self.close("a", s.fa_at, s.fa_airport, s.callsign or own)
        elif s.starts is False:
            self.close("6", s.first_at, UNKNOWN, own, True)
            self.open("6", s.callsign, None, s.first_at, s.last_at, True)
            if s.fa_at is not None:
                self.close("a", s.fa_at, s.fa_airport, s.callsign, True)
        else:
            self.extend("n", s.last_at, s.callsign or own)
        return True

    def at_end(self, s) -> None:
        if self.flying:
            callsign = s.callsign or self.flying["callsign"]
            if s.tail_lands:
                self.close("E", s.last_at, s.last_airport, callsign)
            else:
                self.extend("x", s.last_at, callsign)


def walk(sessions: Iterable[tuple], cfg: DetectorConfig, replay: bool = False) -> Iterator[dict]:
    """The flights of one aircraft's sessions (a row each by session_no, with the stored flights' columns alike in all rows).

    Sessions are read one by one; only the aircraft's flights are held.
    """
    state = previous = s = None
    for s in sessions:
        if state is None:
            stored = {"first_seen": s.open_first_seen, "last_seen": s.open_last_seen, "callsign": s.open_callsign, "departure_airport_icao": s.open_departure, "arrival_airport_icao": None, "needs_review": s.open_review} if s.open_first_seen is not None else None
            completed = {"last_seen": s.done_last_seen, "arrival_airport_icao": s.done_arrival} if s.done_last_seen is not None else None
            state = Walk(cfg, stored, completed, replay)
        if state.on_session(s, previous):
            previous = s
    state.at_end(s)
    for flight in state.written.values():
        yield flight | {"icao24": s.icao24}


def walk_all(sessions: DataFrame, cfg: DetectorConfig, replay: bool, tasks: int = 0) -> DataFrame:
    """The walks of all aircraft, over batches of sorted sessions.

    The number of partitions is `tasks`, else the session's own, as the walk's time isn't in proportion to its bytes, by
    which partitions would be merged. Sessions that are dealt to as many tasks already aren't shuffled again.
    """
    times = [n for n, t in sessions.dtypes if t == "timestamp"]
    rows = sessions.withColumns({n: F.unix_micros(n) for n in times})
    rows = rows.repartition(tasks or int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "icao24").sortWithinPartitions("icao24", "session_no")
    names = [c.split()[0] for c in FLIGHT.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in FLIGHT.split(", ")]
    columns = rows.columns

    def batch_of(flights: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[n] for f in flights], t) for n, t in zip(names, types, strict=True)], names)

    def run(batches):
        row = namedtuple("Session", columns)
        each = (row(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = []
        for _, own in groupby(each, key=lambda r: r.icao24):
            for flight in walk(own, cfg, replay):
                held.append(flight)
                if len(held) == 10_000:
                    yield batch_of(held)
                    held = []
        yield batch_of(held)

    found = rows.mapInArrow(run, FLIGHT)
    return found.withColumns({n: F.timestamp_micros(n) for n in ("first_seen", "last_seen")})


def detect_flights(positions: DataFrame, airports: DataFrame, stored: DataFrame | None, cfg: DetectorConfig, since=None, replay: bool = False, tasks: int | None = None) -> DataFrame:
    """Flights written or changed by a run over positions, given the stored flights (None: none).

    The walk is the only Python here: it sees a row a session, dealt and sorted by aircraft.
    Of several open flights of an aircraft the one with the latest first_seen is taken up. tasks: as in session_features.
    """
    tasks = tasks_for(positions) if tasks is None else tasks
    sessions = session_features(positions, airports, cfg, since, tasks)
    if stored is not None:
        rest = F.struct("first_seen", "last_seen", "callsign", "departure_airport_icao", "needs_review")
        flying = open_flights(stored).groupBy("icao24").agg(F.max_by(rest, "first_seen").alias("o"))
        done = last_completed_flight(stored).select("icao24", F.col("last_seen").alias("done_last_seen"), F.col("arrival_airport_icao").alias("done_arrival"))
        flying = flying.select("icao24", F.col("o.first_seen").alias("open_first_seen"), F.col("o.last_seen").alias("open_last_seen"), F.col("o.callsign").alias("open_callsign"), F.col("o.departure_airport_icao").alias("open_departure"), F.col("o.needs_review").alias("open_review"))
        sessions = sessions.join(flying, "icao24", "left").join(done, "icao24", "left")
    else:
        none = {n: F.lit(None).cast(t) for n, t in (("open_first_seen", "timestamp"), ("open_last_seen", "timestamp"), ("open_callsign", "string"), ("open_departure", "string"), ("open_review", "boolean"), ("done_last_seen", "timestamp"), ("done_arrival", "string"))}
        sessions = sessions.withColumns(none)
    return walk_all(sessions, cfg, replay, tasks)


def covered_sessions(sessions: DataFrame, completed: DataFrame) -> DataFrame:
    """Sessions (icao24, session_no, first_at) that begin at or before the last completed flight's end."""
    return sessions.join(completed.select("icao24", "last_seen"), "icao24").where("first_at <= last_seen").select("icao24", "session_no", "first_at")


def close_stale(flights: DataFrame, positions: DataFrame, airports: DataFrame, as_of, cfg: DetectorConfig) -> DataFrame:
    """Updates that close flights open for too long: at an airport near the last low position, else unknown."""
    stale = open_flights(flights).where(F.col("first_seen") < F.lit(as_of) - F.expr(f"INTERVAL {cfg.stale_hours} HOURS"))
    last = latest_position(positions.join(stale.select("icao24").distinct(), "icao24", "left_semi"))
    near = nearest_airport(last, airports, cfg.proximity_radius_km)
    near = near.select("icao24", F.col("callsign").alias("p_callsign"), "captured_at", F.when(F.col("altitude_m") < cfg.proximity_altitude_m, F.col("airport")).alias("near"))
    rows = stale.join(near, "icao24", "left")
    callsign = F.coalesce(F.when(F.col("captured_at").isNotNull(), F.col("p_callsign")).otherwise(F.col("callsign")), F.col("callsign"))
    return rows.select("icao24", "first_seen", F.coalesce("captured_at", "first_seen").alias("last_seen"), F.coalesce("near", F.lit(UNKNOWN)).alias("arrival_airport_icao"), callsign.alias("callsign"), F.lit(True).alias("needs_review"))


def tails(positions: DataFrame, before, cfg: DetectorConfig, tail: DataFrame | None = None) -> DataFrame:
    """Each aircraft's last rows earlier than `before`, as many as a look-back asks for.

    Given the tail of an earlier time, positions need to hold the rows since then only: so a job keeps the table up to date
    by reading what is new, and incremental_detect never reads history.
    """
    rows = positions.where(F.col("captured_at") < F.lit(before))
    if tail is not None:
        rows = rows.unionByName(tail.select(*positions.columns)).dropDuplicates(["icao24", "captured_at"])
    nth = F.row_number().over(W.partitionBy("icao24").orderBy(F.desc("captured_at")))
    return rows.withColumn("nth", nth).where(F.col("nth") <= max(3, cfg.lookback_rows)).drop("nth")


def incremental_detect(positions: DataFrame, flights: DataFrame, airports: DataFrame, since, as_of, cfg: DetectorConfig, tail: DataFrame | None = None) -> DataFrame:
    """flights after a run over the positions since `since`, with stale flights closed.

    tail: each aircraft's rows just before `since` (see tails); with it positions are read from `since` on only, and once,
    else all of them are. The rows of the run and the flights it finds are written in the shared folder, as both are used twice.
    """
    if tail is None:
        recent = positions
    else:
        new = captured(positions, F.lit(since))
        recent = stage(new.unionByName(tail, allowMissingColumns=True), "recent")
    found = detect_flights(recent, airports, flights, cfg, since).drop("path")
    merged = stage(merge.upsert_flights(flights, found), "merged")
    return merge.update_open_flights(merged, close_stale(merged, recent, airports, as_of, cfg))


def backfill_open_flights(flights: DataFrame, positions: DataFrame, airports: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """What a look over each open flight's later positions gives: `action` 'close', 'new' or 'pending' rows.

    Sessions play no part. The landing closes the flight; only rows after it make new flights. Positions are read once: rows
    up to the landing are leg -1 of the flight, later ones legs from 0, and each leg becomes one row at most.
    """
    opened = open_flights(flights).select("icao24", F.col("first_seen").alias("opened"), F.col("callsign").alias("f_callsign"), F.col("departure_airport_icao").alias("f_dep"))
    own = W.partitionBy("icao24", "opened")
    w, ts = own.orderBy("captured_at"), F.col("captured_at")
    rows = positions.join(opened, "icao24").where("captured_at >= opened").withColumn("latest", F.max("captured_at").over(own))
    rows = with_ground(rows, cfg).where("ground IS NOT NULL")
    rows = rows.withColumn("previous", F.lag(F.struct("captured_at", "latitude", "longitude", "callsign", "ground")).over(w))
    rows = rows.withColumn("landed_at", F.min(F.when(~F.col("previous.ground") & F.col("ground"), ts)).over(own))
    late = F.coalesce(F.col("previous.captured_at") > F.col("landed_at"), F.lit(False))  # the landing row itself is no row before
    takes_off, lands = late & F.col("previous.ground") & ~F.col("ground"), late & ~F.col("previous.ground") & F.col("ground")
    rows = rows.withColumns({"takes_off": takes_off, "lands": lands.cast("int")})
    leg = F.when(ts > F.col("landed_at"), F.sum("lands").over(w) - F.col("lands")).otherwise(-1)  # a landing belongs to the leg it ends
    point = F.struct("captured_at", "latitude", "longitude", "callsign")
    start = F.struct(F.col("previous.captured_at").alias("at"), F.col("previous.latitude").alias("lat"), F.col("previous.longitude").alias("lon"), F.coalesce("callsign", "previous.callsign").alias("cs"))
    legs = rows.withColumn("leg", leg).groupBy("icao24", "opened", "leg").agg(
        F.max_by(start, F.when(F.col("takes_off"), ts)).alias("d"),
        F.max_by(point, F.when((F.col("lands") == 1) | (ts == F.col("landed_at")), ts)).alias("a"),
        *(F.max(c).alias(c) for c in ("f_callsign", "f_dep", "latest")),
    )
    closes, done = F.col("leg") < 0, F.col("a").isNotNull()
    legs = legs.where((closes & done) | (~closes & F.col("d").isNotNull()))
    found = nearest_airports(legs, airports, cfg.airport_radius_km, {"dep": (F.when(~closes, F.col("d.lat")), F.when(~closes, F.col("d.lon"))), "arr": (F.col("a.latitude"), F.col("a.longitude"))})
    dep, arr = F.when(closes, F.col("f_dep")).otherwise(F.col("dep.airport")), F.col("arr.airport")
    return found.select(
        "icao24", "opened", F.when(closes, "close").when(done, "new").otherwise("pending").alias("action"),
        F.when(closes, F.coalesce("a.callsign", "f_callsign")).otherwise(F.coalesce("d.cs", "a.callsign")).alias("callsign"),
        dep.alias("departure_airport_icao"), arr.alias("arrival_airport_icao"),
        F.when(closes, F.col("opened")).otherwise(F.col("d.at")).alias("first_seen"), F.coalesce("a.captured_at", "latest").alias("last_seen"), dep_equals_arr(dep, arr).alias("needs_review"),
    )


def replay_detector(positions: DataFrame, airports: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """The detector over all history without stored state; `path` names the cases each flight went through."""
    return detect_flights(positions, airports, None, cfg, replay=True)


def compare_flights(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of flights, reviews and flights back to their departure, per aircraft and side."""

    def side(df: DataFrame, name: str) -> DataFrame:
        same = dep_equals_arr(F.col("departure_airport_icao"), F.col("arrival_airport_icao"), unknown_counts=False)
        return df.groupBy("icao24").agg(F.count("*").alias(f"{name}_flights"), F.count_if("needs_review").alias(f"{name}_review"), F.count_if(same).alias(f"{name}_same"))

    return side(old, "old").join(side(new, "new"), "icao24", "full_outer").na.fill(0)


