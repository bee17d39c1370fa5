"""Column expressions shared by the jobs. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.config import DetectorConfig

EARTH_RADIUS_M = 6378168.0

#: City codes of airports (fixed values).
CITIES = {
    "EDDM": "MUC", "VTBS": "BKK", "EDDF": "FRA", "KJFK": "JFK", "KLAX": "LAX", "KORD": "ORD", "OMDB": "DXB", "VHHH": "HKG", "RJTT": "NRT", "RKSI": "ICN",
    "WSSS": "SIN", "FAOR": "JNB", "SBGR": "GRU", "LEMD": "MAD", "EGLL": "LHR", "LFPG": "CDG", "EDDB": "BER", "EDDL": "DUS", "EDDS": "STR", "EDDH": "HAM",
    "RPLL": "MNL", "ZSPD": "PVG", "ZBAA": "PEK", "WMKK": "KUL", "VIDP": "DEL", "VABB": "BOM", "LEBL": "BCN", "LIRF": "FCO", "YSSY": "SYD", "OEJN": "JED",
    "OERK": "RUH", "OTHH": "DOH", "OMAA": "AUH", "CYYZ": "YYZ", "KIAH": "IAH", "KMIA": "MIA", "KSFO": "SFO", "CYVR": "YVR", "RJAA": "NRT", "LOWW": "VIE",
    "EHAM": "AMS", "LSZH": "ZRH",
}


def is_on_ground(on_ground: Column, velocity: Column, altitude: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """The reported flag, but slow and low aircraft are on the ground whatever it says; unknown stays unknown."""
    slow_and_low = (velocity < cfg.ground_velocity_ms) & (altitude < cfg.ground_altitude_m)
    return F.when(on_ground.isNull(), F.lit(None).cast("boolean")).otherwise(on_ground | F.coalesce(slow_and_low, F.lit(False)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_code(c: Column, case: str = "upper") -> Column:
    """Stripped, case-folded, blank as null."""
    fold = {"upper": F.upper, "lower": F.lower, "keep": lambda x: x}[case]
    return F.nullif(fold(strip(c)), F.lit(""))


def callsigns_match(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def flight_date(first_seen: Column) -> Column:
    return F.to_date(first_seen)


def duration_minutes(first_seen: Column, last_seen: Column) -> Column:
    seconds = F.round((F.unix_micros(last_seen) - F.unix_micros(first_seen)) / 1_000_000).cast("int")
    return F.floor(F.abs(seconds) / 60).cast("int") * F.signum(seconds).cast("int")


def dep_equals_arr(dep: Column, arr: Column, unknown_counts: bool = True) -> Column:
    same = F.coalesce(dep == arr, F.lit(False))
    return same if unknown_counts else same & (dep != "UNKN")


def aircraft_needs_review(registration: Column, aircraft_type: Column, icao24: Column) -> Column:
    return aircraft_type.isNull() | F.coalesce(registration == F.upper(icao24), F.lit(False))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance over a sphere by the chord between two points, to metres."""
    return chord_km(unit_sphere(lat1, lon1), unit_sphere(lat2, lon2))


def chord_km(one, other) -> Column:
    """great_circle_km of two points of the unit sphere."""
    chord = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(one, other, strict=True)), F.lit(0.0)))
    return F.round(F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(chord / 2, F.lit(1.0))) / 1000, 3)


def route_label(dep: Column, arr: Column, unknown: str | None = "?") -> Column:
    if unknown is None:
        return F.concat(dep, F.lit("-"), arr)
    return F.concat(F.coalesce(dep, F.lit(unknown)), F.lit("-"), F.coalesce(arr, F.lit(unknown)))


def city_label(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), code)


def route_name(route: Column) -> Column:
    ends = F.split(route, "-")
    return F.concat(city_label(F.try_element_at(ends, F.lit(1))), F.lit("→"), city_label(F.try_element_at(ends, F.lit(2))))


def format_duration(minutes: Column) -> Column:
    text = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))
    return F.when(minutes.isNull() | (minutes == 0), F.lit("—")).otherwise(text)


def age_label(ts: Column, as_of: Column) -> Column:
    s = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / 1_000_000)
    label = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, label(1, "s")).when(s < 3600, label(60, "m")).when(s < 86400, label(3600, "h")).otherwise(label(86400, "d"))


def text_search(df: DataFrame, q: str, cols: list[str], together: bool = False) -> DataFrame:
    """Rows of which a column, or all columns joined by blanks, contain q in any case."""
    if together:
        return df.where(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in cols))).contains(q.lower()))
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False))
    return df.where(hit)


def airport_search(airports: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Airports by code prefix or a part of the name; at least two characters."""
    if len(q.strip()) < 2:
        return airports.limit(0)
    hit = F.upper("icao_code").startswith(q.upper()) | F.lower("name").contains(q.lower())
    return airports.where(hit).orderBy("icao_code").limit(limit)


def utc_weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"])), day + 1)
