"""The flight detector as keyed state: a row at a time, so that a batch's cost depends on its own rows only.

Per aircraft the state holds the rows that the watermark hasn't passed yet, the last rows, what the current session has
shown so far, the flight in the air, and the flights whose arrival is still missing. A session is judged when the watermark
has passed the longest gap after its last row; what comes later than the watermark allows is dropped by Spark.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import pandas as pd

from contrail.config import DetectorConfig
from contrail.operators.detector import FLIGHT, UNKNOWN, Walk

SECOND = 1_000_000
#: A position in the state, in this order. Times are epoch microseconds; `cs` is the cleaned callsign, `airport` the nearest within the radius.
ROW = ("ts", "latitude", "longitude", "altitude_m", "ground", "cs", "airport", "airport_km")


def sign(rows: list[SimpleNamespace], count: int, cfg: DetectorConfig) -> str | None:
    """What the last `count` of these rows show of a landing at the last one; see sessions.landing_sign."""
    last, seen = rows[-1], [r.altitude_m for r in rows[-count:] if r.altitude_m is not None]
    if last.ground:
        return "ground"
    spot = lambda r: (r.latitude, r.longitude, r.altitude_m)
    frozen = len(rows[-count:]) >= 3 and spot(rows[-2]) == spot(last) == spot(rows[-3])
    low = last.altitude_m is not None and last.altitude_m < cfg.proximity_altitude_m
    return "low" if low and (frozen or (len(seen) >= 2 and seen[-1] < seen[0])) else None


def lands(rows: list[SimpleNamespace], count: int, cfg: DetectorConfig) -> bool:
    shown = sign(rows, count, cfg) if rows else None
    near = bool(rows) and rows[-1].airport_km is not None and rows[-1].airport_km <= cfg.proximity_radius_km
    return shown == "ground" or (shown == "low" and near)


class Session:
    """What sessions.session_features says of a session, kept up to date row by row."""

    def __init__(self, before: list[SimpleNamespace], cfg: DetectorConfig):
        self.n, self.tail, self.head_altitudes, self.callsign = 0, [], [], None
        self.known = self.since = None  # the last row of known ground flag, and the first callsign since then
        self.first = self.d = self.da = self.fa = self.d_callsign = None
        self.before_lands = lands(before, cfg.lookback_rows, cfg)
        self.before_at, self.before_airport = (before[-1].ts, before[-1].airport) if before else (None, None)

    def add(self, r: SimpleNamespace, cfg: DetectorConfig) -> None:
        self.n += 1
        self.first = self.first or r
        self.tail = [*self.tail, r][-max(3, cfg.tail_rows) :]
        self.callsign = self.callsign or r.cs
        if self.n <= cfg.head_rows and r.altitude_m is not None:
            self.head_altitudes.append(r.altitude_m)
        if self.known is not None and self.known.ground and r.ground is False and self.d is None:
            self.d, self.d_callsign = self.known, self.since
        elif self.known is not None and self.known.ground is False and r.ground:
            self.fa = self.fa or r
            self.da = self.da or (r if self.d is not None else None)
        if self.d is not None:
            self.d_callsign = self.d_callsign or r.cs
        if r.ground is not None:
            self.known, self.since = r, r.cs
        else:
            self.since = self.since or r.cs

    def judged(self, icao24: str, cfg: DetectorConfig) -> SimpleNamespace:
        """The row that the walk asks for."""
        at = lambda r: (None, None) if r is None else (r.ts, r.airport)
        names = ("first", "last", "d", "da", "fa")
        points = dict(zip(names, map(at, (self.first, self.tail[-1], self.d, self.da, self.fa)), strict=True))
        high, start = self.head_altitudes, self.first.altitude_m
        climbs = len(high) >= 2 and high[-1] > high[0] and start is not None and start < cfg.missed_departure_altitude_m
        return SimpleNamespace(
            icao24=icao24, starts=self.first.ground, callsign=self.callsign, d_callsign=self.d_callsign or self.callsign, departs=bool(self.first.ground) or climbs,
            tail_lands=lands(self.tail, cfg.tail_rows, cfg), before_lands=self.before_lands, before_at=self.before_at, before_airport=self.before_airport,
            **{f"{n}_at": p[0] for n, p in points.items()}, **{f"{n}_airport": p[1] for n, p in points.items()},
        )


class Aircraft:
    """One aircraft's state. Only flights in the air or without arrival are kept; all others are out."""

    def __init__(self, icao24: str, cfg: DetectorConfig):
        self.icao24, self.cfg = icao24, cfg
        self.waiting: list[SimpleNamespace] = []
        self.tail: list[SimpleNamespace] = []
        self.session: Session | None = None
        self.previous: SimpleNamespace | None = None
        self.walk = Walk(cfg, None, None, False)
        self.unarrived: dict[int, dict] = {}
        self.changed: dict[int, dict] = {}

    def take(self, rows: Iterable[SimpleNamespace]) -> None:
        """Rows in any order; of several of one time the first stays, and those not later than what was walked are repeats."""
        known = {r.ts for r in self.waiting}
        for r in rows:
            if r.ts not in known and (not self.tail or r.ts > self.tail[-1].ts):
                known.add(r.ts)
                self.waiting.append(r)
        self.waiting.sort(key=lambda r: r.ts)

    def advance(self, watermark: int) -> None:
        """Walks all that can't change any more."""
        gap, n = self.cfg.gap_seconds * SECOND, 0
        for r in self.waiting:
            if r.ts >= watermark:
                break
            if self.session is not None and r.ts - self.session.tail[-1].ts > gap:
                self.end_session()
            if self.session is None:
                self.session = Session(self.tail, self.cfg)
            self.session.add(r, self.cfg)
            self.tail = [*self.tail, r][-max(3, self.cfg.lookback_rows) :]
            n += 1
        self.waiting = self.waiting[n:]
        if self.session is not None and watermark > self.session.tail[-1].ts + gap:
            self.end_session()
        self.close_stale(watermark)

    def end_session(self) -> None:
        s = self.session.judged(self.icao24, self.cfg)
        if self.walk.on_session(s, self.previous):
            self.previous = s
        self.session = None
        tentative = copy.deepcopy(self.walk)  # as if it were the last one
        tentative.at_end(s)
        for at, flight in tentative.written.items():
            self.changed[at] = flight
            self.unarrived.pop(at, None)
            if flight["arrival_airport_icao"] is None:
                self.unarrived[at] = flight
        flying = self.walk.flying and self.walk.flying["first_seen"]
        self.walk.written = {at: flight for at, flight in self.walk.written.items() if at == flying}

    def close_stale(self, watermark: int) -> None:
        """Flights without arrival for too long end at an airport near the last low position, else unknown."""
        for at in [a for a in self.unarrived if a + self.cfg.stale_hours * 3600 * SECOND < watermark]:
            flight, last = self.unarrived.pop(at), self.tail[-1]
            low = last.altitude_m is not None and last.altitude_m < self.cfg.proximity_altitude_m
            near = last.airport if low and last.airport_km is not None and last.airport_km <= self.cfg.proximity_radius_km else None
            self.changed[at] = flight | {"last_seen": last.ts, "arrival_airport_icao": near or UNKNOWN, "callsign": last.cs or flight["callsign"], "needs_review": True, "path": flight["path"] + "s"}

    def next_time(self) -> int | None:
        """When there is something to do without a new row."""
        times = [r.ts for r in self.waiting[:1]] + [a + self.cfg.stale_hours * 3600 * SECOND for a in self.unarrived]
        if self.session is not None:
            times.append(self.session.tail[-1].ts + self.cfg.gap_seconds * SECOND)
        return min(times) if times else None

    def flights(self) -> list[dict]:
        out, self.changed = [f | {"icao24": self.icao24} for f in self.changed.values()], {}
        return out

    def dump(self) -> str:
        """The state as text that any later version of the library can read."""
        session = vars(self.session) if self.session else None
        body = {"waiting": self.waiting, "tail": self.tail, "session": session, "previous": self.previous, "flying": self.walk.flying, "written": list(self.walk.written.items()), "unarrived": list(self.unarrived.items())}
        return json.dumps(body, default=vars)

    @classmethod
    def load(cls, icao24: str, cfg: DetectorConfig, text: str) -> Aircraft:
        own, body = cls(icao24, cfg), json.loads(text)
        row = lambda r: r and SimpleNamespace(**r)
        own.waiting, own.tail, own.previous = list(map(row, body["waiting"])), list(map(row, body["tail"])), row(body["previous"])
        if body["session"]:
            own.session = Session([], cfg)
            vars(own.session).update(body["session"] | {k: row(body["session"][k]) for k in ("first", "known", "d", "da", "fa")} | {"tail": list(map(row, body["session"]["tail"]))})
        own.walk.flying, own.walk.written, own.unarrived = body["flying"], dict(map(tuple, body["written"])), dict(map(tuple, body["unarrived"]))
        return own


def rows_of(frame: pd.DataFrame) -> Iterator[SimpleNamespace]:
    for values in frame[list(ROW)].astype(object).where(frame[list(ROW)].notna(), None).itertuples(index=False, name=None):
        r = dict(zip(ROW, values, strict=True))
        ground = r["ground"]
        yield SimpleNamespace(**r | {"ts": int(r["ts"]), "ground": None if ground is None else bool(ground), **{n: None if r[n] is None else float(r[n]) for n in ("latitude", "longitude", "altitude_m", "airport_km")}})


def on_aircraft(cfg: DetectorConfig):
    """The function for applyInPandasWithState: one aircraft's new rows, or its timer."""
    names = [c.split()[0] for c in FLIGHT.split(", ")]

    def run(key, frames, state) -> Iterator[pd.DataFrame]:
        own = Aircraft.load(key[0], cfg, state.get[0]) if state.exists else Aircraft(key[0], cfg)
        if not state.hasTimedOut:
            for frame in frames:
                own.take(rows_of(frame))
        watermark = state.getCurrentWatermarkMs()
        own.advance(watermark * 1000)
        state.update((own.dump(),))
        later = own.next_time()
        if later is not None:
            state.setTimeoutTimestamp(max(watermark + 1, later // 1000 + 1))
        found = own.flights()
        if found:
            out = pd.DataFrame(found, columns=names)
            yield out.astype({"first_seen": "int64", "last_seen": "int64", "needs_review": "bool"})

    return run
