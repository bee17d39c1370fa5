"""A second, plain implementation of the detector's rules over all aircraft of the test tables, row by row."""

import math
from collections import Counter, defaultdict
from datetime import timedelta

import pytest

from contrail.config import SPARSE, SPARSE_REPLAY
from contrail.fixtures import Tables
from contrail.operators.detector import detect_flights, replay_detector

SF = "/root/testdata/sf0.01"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    chord = math.dist((math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)), (math.cos(c) * math.cos(d), math.cos(c) * math.sin(d), math.sin(c)))
    return round(2 * 6378168.0 * math.asin(min(chord / 2, 1.0)) / 1000, 3)


class Rules:
    def __init__(self, cfg, airports):
        self.cfg, self.airports, self.near = cfg, airports, {}

    def airport(self, row, within):
        """The nearest airport's code, if it is within so many km."""
        place = (row.latitude, row.longitude)
        if place not in self.near:
            self.near[place] = min((km(*place, a.latitude, a.longitude), a.icao_code) for a in self.airports)
        distance, code = self.near[place]
        return code if distance <= within else None

    def arrival(self, row):
        return self.airport(row, self.cfg.airport_radius_km)

    def ground(self, row):
        if row.on_ground is None or row.on_ground:
            return row.on_ground
        return row.velocity_ms is not None and row.altitude_m is not None and row.velocity_ms < 30 and row.altitude_m < 300

    def name(self, rows):
        return next((r.callsign.strip() for r in rows if r.callsign and r.callsign.strip()), None)

    def sessions(self, rows):
        out = []
        for row in rows:
            if out and row.captured_at - out[-1][-1].captured_at <= timedelta(seconds=self.cfg.gap_seconds):
                out[-1].append(row)
            else:
                out.append([row])
        return out

    def departure(self, rows):
        known = [r for r in rows if self.ground(r) is not None]
        return next((a for a, b in zip(known, known[1:], strict=False) if self.ground(a) and not self.ground(b)), None)

    def landing_after(self, rows, when):
        known = [r for r in rows if self.ground(r) is not None]
        return next((b for a, b in zip(known, known[1:], strict=False) if not self.ground(a) and self.ground(b) and b.captured_at > when), None)

    def lands(self, rows, count):
        rows = rows[-count:]
        last = rows[-1] if rows else None
        if last is None or self.ground(last):
            return last
        heights = [r.altitude_m for r in rows if r.altitude_m is not None]
        frozen = len(rows) >= 3 and len({(r.latitude, r.longitude, r.altitude_m) for r in rows[-3:]}) == 1
        low = last.altitude_m is not None and last.altitude_m < self.cfg.proximity_altitude_m
        if low and (frozen or (len(heights) >= 2 and heights[-1] < heights[0])) and self.airport(last, self.cfg.proximity_radius_km):
            return last
        return None

    def departs(self, rows):
        heights = [r.altitude_m for r in rows[: self.cfg.head_rows] if r.altitude_m is not None]
        start = rows[0].altitude_m
        return bool(self.ground(rows[0])) or (len(heights) >= 2 and heights[-1] > heights[0] and start is not None and start < self.cfg.missed_departure_altitude_m)

    def flights(self, rows, stored, done, replay):
        """The flights table of one aircraft by first_seen, as [callsign, departure, arrival, last_seen, review]."""
        table, flying, before = {}, None, None
        if stored:
            table[stored.first_seen] = [stored.callsign, stored.departure_airport_icao, None, stored.last_seen, stored.needs_review]
            flying = (stored.first_seen, (stored.callsign or "").strip() or None, stored.departure_airport_icao)
        done = (done.last_seen, done.arrival_airport_icao) if done else None

        def start(callsign, dep, at, until, review):
            nonlocal flying
            table[at] = [callsign, table[at][1] if at in table else dep, None, until, review]
            flying = (at, callsign, dep)

        def update(until, callsign, arr=None, review=False):
            row = table[flying[0]]
            if row[2] is None:
                row[3], row[0] = until, callsign or row[0]
                if arr is not None:
                    row[2], row[4] = arr, review

        def finish(row, callsign, review=False, arr=...):
            nonlocal flying, done
            arr = self.arrival(row) if arr is ... else arr
            update(row.captured_at, callsign, arr, review or (arr is not None and arr == flying[2]))
            if replay:
                done = (row.captured_at, arr)
            flying = None

        def take_off(session, callsign_of):
            left = self.departure(session)
            if left:
                callsign = callsign_of(left)
                start(callsign, self.arrival(left), left.captured_at, session[-1].captured_at, False)
                if landed := self.landing_after(session, left.captured_at):
                    finish(landed, callsign)

        for session in self.sessions(rows):
            first, last, own = session[0], session[-1], self.name(session)
            if flying and before and (landed := self.lands(before, self.cfg.tail_rows)):
                finish(landed, flying[1])
            begins = self.ground(first)
            landed = self.landing_after(session, first.captured_at)
            if not flying:
                if not replay and done and done[0] >= first.captured_at:
                    continue
                if begins:
                    take_off(session, lambda _: own)  # noqa: B023
                elif begins is False:
                    dep = self.arrival(first) if self.departs(session) else None
                    review = dep is None
                    if dep is None and done and first.captured_at - done[0] <= timedelta(hours=self.cfg.missed_departure_max_gap_h):
                        dep = (done[1] or "").strip() or None
                        review = dep in (None, "UNKN")
                    start(own, dep, first.captured_at, last.captured_at, review)
                    if landed:
                        finish(landed, own, review)
            elif begins:
                earlier = [r for r in rows if r.captured_at < first.captured_at]
                finish(self.lands(earlier, self.cfg.lookback_rows) or first, own or flying[1])
                take_off(session, lambda left: self.name([r for r in session if r.captured_at >= left.captured_at]) or own)  # noqa: B023
            elif begins is False and (flying[1] is None or own is None or flying[1] == own):
                callsign = own or flying[1]
                update(last.captured_at, callsign)
                if landed:
                    finish(landed, callsign)
            elif begins is False:
                finish(first, flying[1], True, "UNKN")
                start(own, None, first.captured_at, last.captured_at, True)
                if landed:
                    finish(landed, own, True)
            else:
                update(last.captured_at, own or flying[1])
            before = session
        if flying:
            callsign = self.name(before) or flying[1]
            if landed := self.lands(before, self.cfg.tail_rows):
                finish(landed, callsign)
            else:
                update(before[-1].captured_at, callsign)
        return table


@pytest.fixture(scope="module")
def tables(spark):
    t = Tables(spark, SF)
    tracks = defaultdict(list)
    for row in t.positions.orderBy("icao24", "captured_at").collect():
        tracks[row.icao24].append(row)
    return t, tracks, t.airports.collect(), t.flight_seed.collect()


def _rows(found):
    return sorted((r.icao24, r.first_seen, r.callsign or "", r.departure_airport_icao or "", r.arrival_airport_icao or "", r.last_seen, r.needs_review) for r in found)


def _expected(rules, tracks, seeds, replay):
    stored = {s.icao24: s for s in seeds if s.arrival_airport_icao is None}
    done = {s.icao24: s for s in seeds if s.arrival_airport_icao is not None}
    out = []
    for icao24, rows in tracks.items():
        for first_seen, (callsign, dep, arr, last_seen, review) in rules.flights(rows, stored.get(icao24), done.get(icao24), replay).items():
            out.append((icao24, first_seen, callsign or "", dep or "", arr or "", last_seen, review))
    return sorted(out)


def test_detect_flights(tables):
    t, tracks, airports, seeds = tables
    found = detect_flights(t.positions, t.airports, t.flight_seed, SPARSE).collect()
    assert _rows(found) == _expected(Rules(SPARSE, airports), tracks, seeds, replay=False)


def test_replay_detector(tables):
    t, tracks, airports, _ = tables
    found = replay_detector(t.positions, t.airports, SPARSE_REPLAY).collect()
    assert _rows(found) == _expected(Rules(SPARSE_REPLAY, airports), tracks, [], replay=True)
    cases = Counter("".join(r.path for r in found))
    assert all(cases[c] for c in "D2356aeEnx"), cases  # case 4 has hand-made tracks in test_detector.py
