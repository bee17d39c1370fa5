"""The registered queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from contrail.fixtures import VIEWS
from contrail.functions.scalars import CITIES

ORACLES: dict[str, str] = {}
GROUND = "CASE WHEN on_ground IS NULL THEN NULL WHEN on_ground THEN TRUE ELSE coalesce(velocity_ms < 30 AND altitude_m < 300, FALSE) END"
KM = "round(2 * 6378168.0 * asin(least(sqrt(pow(cos(radians({a})) * cos(radians({b})) - cos(radians({c})) * cos(radians({d})), 2) + pow(cos(radians({a})) * sin(radians({b})) - cos(radians({c})) * sin(radians({d})), 2) + pow(sin(radians({a})) - sin(radians({c})), 2)) / 2, 1.0)) / 1000, 3)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CS = "nullif(" + STRIP.format("callsign") + ", '')"
US = "epoch_us({})"
#: Chains of views that several queries share.
G = f"g AS (SELECT *, {GROUND} AS ground, {CS} AS cs FROM positions)"
SESSIONS = f"{G}, b AS (SELECT *, coalesce(captured_at - lag(captured_at) OVER w > INTERVAL 24 HOUR, FALSE)::INT AS brk FROM g WINDOW w AS (PARTITION BY icao24 ORDER BY captured_at)), s AS (SELECT *, (sum(brk) OVER (PARTITION BY icao24 ORDER BY captured_at))::INT AS session_no FROM b)"
EDGES = f"{SESSIONS}, k AS (SELECT *, lag(ground) OVER w AS pg, lag(captured_at) OVER w AS pt FROM s WHERE ground IS NOT NULL WINDOW w AS (PARTITION BY icao24, session_no ORDER BY captured_at)), e AS (SELECT *, CASE WHEN pg AND NOT ground THEN 'departure' WHEN NOT pg AND ground THEN 'arrival' END AS edge FROM k)"
NEAR = "d AS (SELECT p.latitude, p.longitude, icao_code, " + KM.format(a="p.latitude", b="p.longitude", c="a.latitude", d="a.longitude") + " AS km FROM (SELECT DISTINCT latitude, longitude FROM positions) p, airports a), near AS (SELECT latitude, longitude, min(km) AS km, arg_min(icao_code, (km, icao_code)) AS code FROM d GROUP BY ALL)"
UPDATES = "u AS (SELECT icao24, CASE WHEN id % 12 = 0 THEN first_seen ELSE first_seen + INTERVAL 1 SECOND END AS first_seen, last_seen + INTERVAL 1 HOUR AS last_seen, CASE WHEN id % 4 = 0 THEN 'NEW1' END AS callsign, 'Z000' AS departure_airport_icao, CASE WHEN id % 24 = 0 THEN 'Z001' END AS arrival_airport_icao, id % 9 = 0 AS needs_review FROM flights WHERE id % 6 = 0)"
REGISTER = "rg AS (SELECT row_no, " + ", ".join(f"nullif({fold}({STRIP.format(c)}), '') AS {n}" for c, n, fold in (("icao24", "icao24", "lower"), ("registration", "registration", "upper"), ("typecode", "aircraft_type", "upper"), ("model", "aircraft_subtype", ""), ("operatoricao", "operator", "upper"))) + " FROM registry), cr AS (SELECT * FROM rg WHERE icao24 IS NOT NULL AND registration IS NOT NULL)"
AIRLINE = REGISTER + ", al AS (SELECT * FROM (SELECT *, CASE WHEN operator = 'DLH' THEN 'operator' WHEN operator IS NULL AND registration LIKE 'D-A%' THEN 'prefix' END AS rule FROM cr) WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY row_no) = 1)"
FLOWN = "fl AS (SELECT f.*, registration, is_active, departure_airport_icao || '-' || arrival_airport_icao AS route FROM flights f JOIN (SELECT icao24, registration, is_active FROM aircraft WHERE aircraft_type = 'MACH') a USING (icao24) WHERE departure_airport_icao IS NOT NULL AND arrival_airport_icao IS NOT NULL), fr AS (SELECT * FROM fl WHERE NOT needs_review), fo AS (SELECT * FROM fr WHERE route = 'A001-A002')"
GAPS = FLOWN + ", gp AS (SELECT * FROM (SELECT registration, flight_date - lag(flight_date) OVER (PARTITION BY registration ORDER BY first_seen, id) AS gap FROM fo) WHERE gap IS NOT NULL)"
TRANS = FLOWN + ", tr AS (SELECT from_route, to_route, count(*) AS n FROM (SELECT route AS from_route, lead(route) OVER (PARTITION BY registration ORDER BY first_seen, id) AS to_route FROM fr) WHERE to_route IS NOT NULL GROUP BY ALL ORDER BY n DESC, from_route, to_route LIMIT 80)"
HEX = "('0x' || icao24)::BIGINT"
EXTERNAL = f"ex AS (SELECT CASE WHEN k % 50 = 1 THEN 'N-' || k ELSE upper(registration) END AS registration, upper(CASE WHEN k % 4 = 0 THEN 'XTYP' ELSE coalesce(aircraft_type, 'FILL') END) AS their_type FROM (SELECT *, {HEX} AS k FROM aircraft) WHERE k % 3 <> 0), ow AS (SELECT upper(registration) AS registration, nullif(upper(aircraft_type), '') AS our_type, is_active, icao24 FROM aircraft), df AS (SELECT coalesce(ex.registration, ow.registration) AS registration, icao24, their_type, our_type, CASE WHEN ex.registration IS NOT NULL AND ow.registration IS NOT NULL THEN 'both' WHEN ow.registration IS NULL THEN 'external' ELSE 'fleet' END AS side, ex.registration IS NOT NULL AND ow.registration IS NOT NULL AND coalesce(their_type <> our_type, FALSE) AS mismatch, ex.registration IS NOT NULL AND ow.registration IS NOT NULL AND their_type IS NOT NULL AND our_type IS NULL AS fillable, ex.registration IS NOT NULL AND ow.registration IS NOT NULL AND NOT is_active AS reactivate FROM ex FULL JOIN ow USING (registration))"
SEEN = "seen AS (SELECT DISTINCT icao24 FROM positions WHERE captured_at >= TIMESTAMP '2024-01-24')"
EDITS = f"ed AS (SELECT kind, key, k % 4 AS act, CASE WHEN k % 3 > 0 THEN 'D-NEW' END AS registration, CASE WHEN k % 3 > 0 THEN 'T123' END AS type, CASE WHEN k % 3 > 0 THEN 'Sub' END AS subtype, CASE WHEN k % 3 > 0 THEN 'B001' END AS dep, CASE WHEN k % 3 > 0 THEN 'B002' END AS arr FROM (SELECT 'aircraft' AS kind, icao24 AS key, {HEX} AS k FROM aircraft WHERE needs_review UNION ALL SELECT 'flight', id::VARCHAR, id FROM flights WHERE needs_review))"
LAST_RUNS = "ty AS (SELECT unnest(['state_poller', 'flight_detector', 'fleet_discovery', 'fleet_refresh']) AS run_type), lr AS (SELECT run_type, id, status, started_at FROM ty LEFT JOIN (SELECT * FROM batch_runs QUALIFY row_number() OVER (PARTITION BY run_type ORDER BY started_at DESC, id DESC) = 1) USING (run_type))"
FK = "icao24, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, callsign, departure_airport_icao, arrival_airport_icao, needs_review"
SIDES = "a AS (SELECT icao24, first_seen, last_seen, departure_airport_icao AS d, arrival_airport_icao AS r, needs_review FROM flights WHERE id % 3 <> 0), b AS (SELECT icao24, first_seen, last_seen, departure_airport_icao AS d, arrival_airport_icao AS r, needs_review FROM flights WHERE id % 4 <> 0)"
POS = "SELECT {} FROM positions"
T = "epoch_us(captured_at) AS captured_at"


def oracle(name: str, body: str, chain: str = "", recursive: bool = False) -> None:
    """body over the chain's views and the test tables it needs."""
    text = f"{chain} {body}"
    used = [v for v in VIEWS if f" {v}" in text.replace("(", " ").replace(",", " ")]
    ORACLES[name] = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([*(f"{v} AS ({VIEWS[v]})" for v in used), *([chain] if chain else [])]) + f" {body}"


o = oracle
o("s01_parse_state_snapshots", f"SELECT icao24, nullif(upper({STRIP.format('callsign')}), '') AS callsign, epoch_us(date_trunc('second', captured_at)) AS captured_at, latitude, longitude, altitude_m, velocity_ms, heading, on_ground FROM positions")
o("s02_filter_fleet", f"SELECT icao24, {T} FROM positions WHERE icao24 IN (SELECT icao24 FROM aircraft WHERE is_active AND aircraft_type IN ('MACH', 'AUTO'))")
o("s03_filter_callsign_prefix", f"SELECT icao24, {T} FROM positions WHERE upper(trim(callsign)) LIKE 'DLH101%'")
o("s04_drop_no_fix", "SELECT count(*) FILTER (heading > 30) AS kept, count(*) FILTER (heading <= 30) AS skipped FROM positions")
o("s05_insert_positions", f"SELECT icao24, {T}, callsign, latitude FROM positions WHERE latitude >= 0")
o("s06_parse_flight_feed", "SELECT icao24, callsign, departure_airport_icao, arrival_airport_icao, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen FROM flights WHERE icao24 IN (SELECT icao24 FROM aircraft WHERE is_active)")
o("s07_time_chunks", "SELECT *, least(chunk_begin + 7200, end_s) AS chunk_end FROM (SELECT *, unnest(range(begin_s, end_s, 7200)) AS chunk_begin FROM (SELECT id, epoch(first_seen)::BIGINT AS begin_s, epoch(last_seen)::BIGINT AS end_s FROM flights))")
o("s08_load_airports", "SELECT icao_code, trim(name) AS name, latitude, CASE WHEN k % 2 = 0 THEN longitude + 1 ELSE longitude END AS longitude FROM (SELECT *, substr(icao_code, 2, 3)::INT AS k FROM airports) WHERE k % 3 > 0 AND k % 7 > 0")
o("s09_airline_fleet", "SELECT icao24, registration, aircraft_type, aircraft_subtype, rule FROM al", AIRLINE)
o("s10_register_lookup", "SELECT icao24, registration, aircraft_type, aircraft_subtype FROM x WHERE (SELECT count(DISTINCT icao24) FROM x) < (SELECT count(*) FROM aircraft) OR row_no <= (SELECT max(m) FROM (SELECT min(row_no) AS m FROM x GROUP BY icao24)) QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY row_no DESC) = 1", REGISTER + ", x AS (SELECT * FROM cr WHERE icao24 IN (SELECT icao24 FROM aircraft))")
o("s11_parse_type_record", f"SELECT icao24, aircraft_type, coalesce(CASE WHEN {HEX} % 2 > 0 THEN aircraft_subtype END, 'Model') AS aircraft_subtype FROM aircraft")
o("s12_aircraft_from_flight_pages", "SELECT upper(registration) AS registration, count(*) AS flight_count, arg_min(t, (flight_date, id)) AS aircraft_type, nullif(arg_min(coalesce(c, '~'), (flight_date, id)), '~') AS callsign, nullif(arg_min(coalesce(d, '~'), (flight_date, id)), '~') AS origin, nullif(arg_min(coalesce(r, '~'), (flight_date, id)), '~') AS destination FROM (SELECT f.id, f.flight_date, registration, upper(aircraft_type) AS t, callsign AS c, departure_airport_icao AS d, arrival_airport_icao AS r FROM flights f JOIN aircraft USING (icao24)) GROUP BY 1".replace("arg_min(t, (flight_date, id))", "nullif(arg_min(coalesce(t, '~'), (flight_date, id)), '~')"))
o("s13_write_positions", f"SELECT icao24, {T}, callsign, altitude_m, strftime(captured_at, '%Y-%m-%d') AS day FROM positions")
o("s13_bucketed_positions", "SELECT icao24, count(*) AS n, epoch_us(min(captured_at)) AS first_at, epoch_us(max(captured_at)) AS last_at, count(DISTINCT CAST(captured_at AS DATE)) AS days FROM positions GROUP BY icao24")
o("s14_load_review_edits", "SELECT kind, key, CASE act WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'DISMISS' WHEN 2 THEN 'PENDING' ELSE 'MAYBE' END AS action, registration, type, subtype, dep, arr, act < 3 AS known FROM ed", EDITS)
o("s15_is_on_ground", f"SELECT icao24, {T}, ground FROM g", G)
o("s16_clean_code", "SELECT row_no, icao24, registration, operator FROM rg", REGISTER)
o("s17_callsigns_match", f"SELECT icao24, {T}, callsign IS NULL OR p IS NULL OR callsign = p AS same FROM (SELECT *, lag(callsign) OVER (PARTITION BY icao24 ORDER BY captured_at) AS p FROM positions)")
o("s18_flight_columns", "SELECT id, CAST(flight_date AS VARCHAR) AS flight_day, duration_minutes AS minutes FROM flights")
o("s19_dep_equals_arr", "SELECT id, coalesce(departure_airport_icao = arrival_airport_icao, FALSE) AS same, coalesce(departure_airport_icao = arrival_airport_icao, FALSE) AND departure_airport_icao <> 'UNKN' AS same_known FROM flights".replace("AND departure_airport_icao <> 'UNKN'", "AND coalesce(departure_airport_icao <> 'UNKN', TRUE)"))
o("s20_aircraft_needs_review", "SELECT icao24, aircraft_type IS NULL OR registration = upper(icao24) AS review FROM aircraft")
o("s21_great_circle_km", f"SELECT icao24, {T}, round(" + KM.format(a="latitude", b="longitude", c="la", d="lo") + ", 1) AS km FROM (SELECT *, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo FROM positions WINDOW w AS (PARTITION BY icao24 ORDER BY captured_at))")
o("s22_route_label", "SELECT id, coalesce(departure_airport_icao, '?') || '-' || coalesce(arrival_airport_icao, '?') AS label, departure_airport_icao || '-' || arrival_airport_icao AS strict FROM flights")
o("s23_city_label", f"SELECT id, CASE WHEN id % 2 = 0 THEN '{CITIES['EDDM']}' ELSE departure_airport_icao END AS city, CASE WHEN id % 2 = 0 THEN '{CITIES['EDDM']}' ELSE departure_airport_icao END || '→{CITIES['VTBS']}' AS route FROM flights")
o("s24_format_duration", "SELECT id, CASE WHEN m IS NULL OR m = 0 THEN '—' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS text FROM (SELECT id, CASE WHEN id % 9 > 0 THEN duration_minutes % 700 END AS m FROM flights)")
o("s25_age_label", "SELECT id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM (SELECT id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(started_at)) // 1000000 AS s FROM batch_runs)")
o("s26_text_search", "SELECT icao24, 'any' AS mode FROM aircraft WHERE registration ILIKE '%auto%' OR aircraft_type ILIKE '%auto%' UNION ALL SELECT icao24, 'together' FROM aircraft WHERE (registration || ' ' || coalesce(aircraft_type, '')) ILIKE '%1 a%' UNION ALL (SELECT icao_code, 'airport' FROM airports WHERE icao_code LIKE 'A00%' OR name ILIKE '%a00%' ORDER BY icao_code LIMIT 20)")
o("s27_utc_weekday", "SELECT id, dayofweek(first_seen)::INT AS dow, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][dayofweek(first_seen) + 1] AS day FROM flights")
o("s28_nearest_airport", f"SELECT p.icao24, epoch_us(p.captured_at) AS captured_at, CASE WHEN km <= 50 THEN code END AS a50, CASE WHEN km <= 50 THEN round(km, 1) END AS km, CASE WHEN km <= 8 THEN code END AS a8 FROM positions p LEFT JOIN near USING (latitude, longitude)", NEAR)
o("s29_flights_with_aircraft", "SELECT id, registration, aircraft_type FROM flights f JOIN aircraft USING (icao24)")
o("s30_latest_position", f"SELECT icao24, {T}, latitude, on_ground FROM positions QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY captured_at DESC) = 1")
o("s31_last_completed_flight", "SELECT icao24, id FROM flights WHERE arrival_airport_icao IS NOT NULL QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY last_seen DESC, first_seen DESC) = 1")
o("s32_open_flights", "SELECT id FROM flights WHERE arrival_airport_icao IS NULL")
o("s33_positions_before", "SELECT icao24, epoch_us(moment) AS \"at\", count(c) AS n, epoch_us(min(c)) AS oldest, epoch_us(max(c)) AS newest FROM (SELECT e.icao24, moment, p.captured_at AS c FROM (SELECT DISTINCT icao24, captured_at + INTERVAL 1 SECOND * CASE WHEN heading > 180 THEN 1 ELSE 0 END AS moment FROM positions) e LEFT JOIN positions p ON e.icao24 = p.icao24 AND p.captured_at < moment QUALIFY row_number() OVER (PARTITION BY e.icao24, moment ORDER BY p.captured_at DESC) <= 15) GROUP BY ALL")
o("s34_positions_range", f"SELECT icao24, {T}, 'range' AS scan FROM positions WHERE icao24 = '000005' AND captured_at BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-31' UNION ALL SELECT icao24, {T}, 'since' FROM positions WHERE captured_at >= TIMESTAMP '2024-01-20'")
o("s35_split_sessions", f"SELECT icao24, {T}, session_no FROM s", SESSIONS)
o("s36_session_callsign", "SELECT icao24, session_no, arg_min(cs, captured_at) FILTER (cs IS NOT NULL) AS session_callsign FROM s GROUP BY ALL", SESSIONS)
o("s37_ground_transitions", f"SELECT icao24, {T}, edge, epoch_us(pt) AS previous_at FROM e WHERE edge IS NOT NULL", EDGES)
o("s38_first_departure", "SELECT icao24, session_no, epoch_us(min(pt)) AS captured_at FROM e WHERE edge = 'departure' GROUP BY ALL", EDGES)
o("s39_first_arrival_after", "SELECT icao24, session_no, epoch_us(min(captured_at)) AS captured_at FROM e JOIN (SELECT icao24, session_no, min(pt) AS d FROM e WHERE edge = 'departure' GROUP BY ALL) USING (icao24, session_no) WHERE edge = 'arrival' AND captured_at > d GROUP BY ALL", EDGES)
o(
    "s40_detect_landing",
    f"SELECT icao24, session_no, {T}, CASE WHEN ground THEN 'ground' ELSE 'low' END AS sign FROM l LEFT JOIN near USING (latitude, longitude) WHERE ground OR (altitude_m < 500 AND (descending OR frozen) AND km <= 8)",
    SESSIONS + ", " + NEAR + ", r AS (SELECT *, row_number() OVER (PARTITION BY icao24, session_no ORDER BY captured_at DESC) AS back FROM s), y AS (SELECT icao24, session_no, arg_max(altitude_m, captured_at) FILTER (altitude_m IS NOT NULL) < arg_min(altitude_m, captured_at) FILTER (altitude_m IS NOT NULL) AS descending, count(*) >= 3 AND count(DISTINCT latitude) FILTER (back <= 3) = 1 AND count(DISTINCT longitude) FILTER (back <= 3) = 1 AND count(DISTINCT altitude_m) FILTER (back <= 3) = 1 AND count(altitude_m) FILTER (back <= 3) = 3 AS frozen FROM r WHERE back <= 15 GROUP BY ALL), l AS (SELECT * FROM r JOIN y USING (icao24, session_no) WHERE back = 1)",
)
o(
    "s41_detect_departure",
    f"SELECT icao24, session_no, {T} FROM r JOIN y USING (icao24, session_no) WHERE nth = 1 AND (ground OR (climbing AND altitude_m < 3000))",
    SESSIONS + ", r AS (SELECT *, row_number() OVER (PARTITION BY icao24, session_no ORDER BY captured_at) AS nth FROM s), y AS (SELECT icao24, session_no, arg_max(altitude_m, captured_at) FILTER (altitude_m IS NOT NULL) > arg_min(altitude_m, captured_at) FILTER (altitude_m IS NOT NULL) AS climbing FROM r WHERE nth <= 5 GROUP BY ALL)",
)
def landing_sign(frame: str, order: str) -> str:
    """The landing sign of a row from the rows up to it; the windows' names."""
    same = " AND ".join(f"lag({c}, {k}) OVER {order} IS NOT DISTINCT FROM {c}" for k in (1, 2) for c in ("latitude", "longitude", "altitude_m"))
    falls = f"count(altitude_m) OVER {frame} >= 2 AND last_value(altitude_m IGNORE NULLS) OVER {frame} < first_value(altitude_m IGNORE NULLS) OVER {frame}"
    return f"CASE WHEN ground THEN 'ground' WHEN altitude_m < 500 AND (({falls}) OR (count(*) OVER {frame} >= 3 AND {same})) THEN 'low' END"


BY = "PARTITION BY icao24, session_no ORDER BY captured_at"
OF_AIRCRAFT = "PARTITION BY icao24 ORDER BY captured_at"
ENDS = ("first", "last", "d", "da", "fa", "before")


def features(lookback: int, since: str = "TRUE") -> str:
    """Views up to sf, a row a session with all that the walk asks for."""
    ends = ", ".join(
        f"arg_min({at}, captured_at) FILTER ({rows}) AS {p}_at, arg_min({lat}, captured_at) FILTER ({rows}) AS {p}_lat, arg_min({lon}, captured_at) FILTER ({rows}) AS {p}_lon"
        for p, at, lat, lon, rows in (("first", "captured_at", "latitude", "longitude", "nth = 1"), ("last", "captured_at", "latitude", "longitude", "back = 1"), ("d", "pt", "plat", "plon", "up"), ("da", "captured_at", "latitude", "longitude", "down AND captured_at > d0"), ("fa", "captured_at", "latitude", "longitude", "down"), ("before", "b_at", "b_lat", "b_lon", "nth = 1"))
    )
    airports = ", ".join(f"{p}_at, CASE WHEN n_{p}.km <= 50 THEN n_{p}.code END AS {p}_airport" for p in ENDS)
    joins = " ".join(f"LEFT JOIN near n_{p} ON n_{p}.latitude = f.{p}_lat AND n_{p}.longitude = f.{p}_lon" for p in ENDS)
    return f"""{G}, {NEAR},
sg AS (SELECT *, {landing_sign('af', 'a')} AS sign FROM g WINDOW a AS ({OF_AIRCRAFT}), af AS ({OF_AIRCRAFT} ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW)),
bf AS (SELECT *, lag(captured_at) OVER a AS b_at, lag(latitude) OVER a AS b_lat, lag(longitude) OVER a AS b_lon, lag(sign) OVER a AS b_sign FROM sg WINDOW a AS ({OF_AIRCRAFT})),
br AS (SELECT *, coalesce(captured_at - lag(captured_at) OVER ({OF_AIRCRAFT}) > INTERVAL 24 HOUR, FALSE)::INT AS brk FROM bf WHERE {since}),
se AS (SELECT *, (sum(brk) OVER ({OF_AIRCRAFT}))::INT AS session_no FROM br),
tl AS (SELECT *, {landing_sign('tf', 't')} AS tail, row_number() OVER t AS nth, row_number() OVER ({BY} DESC) AS back FROM se WINDOW t AS ({BY}), tf AS ({BY} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
kn AS (SELECT icao24, captured_at, lag(ground) OVER t AS pg, lag(captured_at) OVER t AS pt, lag(latitude) OVER t AS plat, lag(longitude) OVER t AS plon FROM se WHERE ground IS NOT NULL WINDOW t AS ({BY})),
eg AS (SELECT tl.*, pt, plat, plon, coalesce(pg AND NOT ground, FALSE) AS up, coalesce(NOT pg AND ground, FALSE) AS down FROM tl LEFT JOIN kn USING (icao24, captured_at)),
dp AS (SELECT *, min(CASE WHEN up THEN pt END) OVER (PARTITION BY icao24, session_no) AS d0 FROM eg),
f AS (SELECT icao24, session_no, count(*) AS n, bool_or(ground) FILTER (nth = 1) AS starts, arg_min(cs, captured_at) FILTER (cs IS NOT NULL) AS callsign, arg_min(cs, captured_at) FILTER (cs IS NOT NULL AND captured_at >= d0) AS d_cs,
 count(altitude_m) FILTER (nth <= 5) AS heights, arg_min(altitude_m, captured_at) FILTER (nth <= 5 AND altitude_m IS NOT NULL) AS low, arg_max(altitude_m, captured_at) FILTER (nth <= 5 AND altitude_m IS NOT NULL) AS high,
 max(altitude_m) FILTER (nth = 1) AS start_m, max(tail) FILTER (back = 1) AS tail, max(b_sign) FILTER (nth = 1) AS before_sign, {ends} FROM dp GROUP BY ALL),
sf AS MATERIALIZED (SELECT f.icao24, f.session_no, n, starts, callsign, coalesce(d_cs, callsign) AS d_callsign, coalesce(starts, FALSE) OR coalesce(heights >= 2 AND high > low AND start_m < 3000, FALSE) AS departs, {airports},
 coalesce(tail = 'ground' OR (tail = 'low' AND n_last.km <= 8), FALSE) AS tail_lands, coalesce(before_sign = 'ground' OR (before_sign = 'low' AND n_before.km <= 8), FALSE) AS before_lands FROM f {joins})"""


o("s42_session_features", "SELECT * REPLACE (" + ", ".join(f"epoch_us({p}_at) AS {p}_at" for p in ENDS) + ") FROM sf", features(15))


def walk(stored: str, replay: bool) -> str:
    """Views up to fw, the flights written by a walk over sf: a step a session carries the flight in the air and what each step writes.

    A write 'o' opens the flight of that first_seen anew, a write 'u' changes it if it has no arrival yet.
    """
    write = "{{'kind': '{}', 'key': {}, 'until': {}, 'cs': {}, 'dep': {}, 'arr': {}, 'review': {}, 'step': {}}}".format
    same = "coalesce({} = {}, FALSE)".format
    # modes: s covered, D take-off, 2 missed departure, z unknown start, t turn-round, n unknown in the air, 5 goes on, 6 another callsign
    return f"""
st AS (SELECT icao24, first_seen, last_seen, callsign, departure_airport_icao, arrival_airport_icao, needs_review FROM {stored}),
wk AS (
 SELECT a.icao24, -1 AS step, p.first_seen AS fly, nullif(trim(p.callsign), '') AS own, p.departure_airport_icao AS dep, c.last_seen AS done_at, c.arrival_airport_icao AS done_arr, FALSE AS p_lands, NULL::TIMESTAMP AS p_at, NULL::VARCHAR AS p_arr,
  CASE WHEN p.icao24 IS NULL THEN [] ELSE [{write('o', 'p.first_seen', 'p.last_seen', 'p.callsign', 'p.departure_airport_icao', 'NULL::VARCHAR', 'p.needs_review', "''")}] END AS writes
 FROM (SELECT DISTINCT icao24 FROM sf) a LEFT JOIN (SELECT * FROM st WHERE arrival_airport_icao IS NULL) p USING (icao24) LEFT JOIN (SELECT * FROM st WHERE arrival_airport_icao IS NOT NULL) c ON c.icao24 = a.icao24
 UNION ALL
 SELECT icao24, step,
  CASE WHEN mode IN ('D', 't', '2', '6') THEN CASE WHEN l_at IS NULL THEN o_at END WHEN mode = '5' AND l_at IS NOT NULL THEN NULL ELSE fly END,
  CASE WHEN mode IN ('D', 't', '2', '6') THEN o_cs ELSE own END, CASE WHEN mode IN ('D', 't', '2', '6') THEN o_dep ELSE dep END,
  CASE WHEN NOT {replay} THEN done_at WHEN l_at IS NOT NULL THEN l_at WHEN mode = 't' THEN t_at WHEN mode = '6' THEN first_at ELSE done_at END,
  CASE WHEN NOT {replay} THEN done_arr WHEN l_at IS NOT NULL THEN l_arr WHEN mode = 't' THEN t_arr WHEN mode = '6' THEN 'UNKN' ELSE done_arr END,
  CASE WHEN mode = 's' THEN p_lands ELSE tail_lands END, CASE WHEN mode = 's' THEN p_at ELSE last_at END, CASE WHEN mode = 's' THEN p_arr ELSE last_airport END,
  list_filter([
   CASE WHEN ended IS NOT NULL THEN {write('u', 'ended', 'p_at', 'own', 'NULL', 'p_arr', same('p_arr', 'dep'), "'e'")} END,
   CASE WHEN mode = 't' THEN {write('u', 'fly', 't_at', 'coalesce(callsign, own)', 'NULL', 't_arr', same('t_arr', 'dep'), "CASE WHEN before_lands THEN '4' ELSE '3' END")} END,
   CASE WHEN mode = '6' THEN {write('u', 'fly', 'first_at', 'own', 'NULL', "'UNKN'", 'TRUE', "'6'")} END,
   CASE WHEN mode IN ('5', 'n') THEN {write('u', 'fly', 'last_at', 'coalesce(callsign, own)', 'NULL', 'NULL', 'FALSE', 'mode')} END,
   CASE WHEN o_at IS NOT NULL THEN {write('o', 'o_at', 'last_at', 'o_cs', 'o_dep', 'NULL', 'o_review', "CASE WHEN mode = 't' THEN 'D' ELSE mode END")} END,
   CASE WHEN l_at IS NOT NULL THEN {write('u', 'coalesce(o_at, fly)', 'l_at', "CASE WHEN mode = '5' THEN coalesce(callsign, own) ELSE o_cs END", 'NULL', 'l_arr', "o_review OR " + same('l_arr', "CASE WHEN mode = '5' THEN dep ELSE o_dep END"), "'a'")} END
  ], lambda w: w IS NOT NULL)
 FROM (
  SELECT *, CASE WHEN mode IN ('D', 't') THEN d_at WHEN mode IN ('2', '6') THEN first_at END AS o_at, CASE WHEN mode = 't' THEN d_callsign ELSE callsign END AS o_cs,
   CASE WHEN mode IN ('D', 't') THEN d_airport WHEN mode = '2' THEN m_dep END AS o_dep, mode = '6' OR (mode = '2' AND NOT m_own AND coalesce(m_dep, 'UNKN') = 'UNKN') AS o_review,
   CASE WHEN mode IN ('D', 't') THEN da_at WHEN mode IN ('2', '5', '6') THEN fa_at END AS l_at, CASE WHEN mode IN ('D', 't') THEN da_airport ELSE fa_airport END AS l_arr,
   CASE WHEN before_lands THEN before_at ELSE first_at END AS t_at, CASE WHEN before_lands THEN before_airport ELSE first_airport END AS t_arr
  FROM (
   SELECT *, CASE WHEN fly IS NULL AND NOT {replay} AND done_at >= first_at THEN 's' WHEN fly IS NULL AND starts THEN 'D' WHEN fly IS NULL AND NOT starts THEN '2' WHEN fly IS NULL THEN 'z' WHEN starts THEN 't' WHEN starts IS NULL THEN 'n' WHEN coalesce(own = callsign, TRUE) THEN '5' ELSE '6' END AS mode,
    departs AND first_airport IS NOT NULL AS m_own, CASE WHEN departs AND first_airport IS NOT NULL THEN first_airport WHEN first_at - done_at <= INTERVAL 48 HOUR THEN nullif(trim(done_arr), '') END AS m_dep
   FROM (
    SELECT sf.*, wk.step + 1 AS step, CASE WHEN p_lands THEN fly END AS ended, CASE WHEN NOT p_lands THEN fly END AS fly, own, dep, p_lands, p_at, p_arr,
     CASE WHEN {replay} AND p_lands AND fly IS NOT NULL THEN p_at ELSE done_at END AS done_at, CASE WHEN {replay} AND p_lands AND fly IS NOT NULL THEN p_arr ELSE done_arr END AS done_arr
    FROM wk JOIN sf ON sf.icao24 = wk.icao24 AND sf.session_no = wk.step + 1)))),
ew AS (SELECT icao24, step, unnest(writes) AS w, generate_subscripts(writes, 1) AS nth FROM wk
 UNION ALL SELECT wk.icao24, step + 1, {write('u', 'fly', 'last_at', 'coalesce(callsign, own)', 'NULL::VARCHAR', 'CASE WHEN tail_lands THEN last_airport END', 'tail_lands AND ' + same('last_airport', 'dep'), "CASE WHEN tail_lands THEN 'E' ELSE 'x' END")}, 1
  FROM wk JOIN sf ON sf.icao24 = wk.icao24 AND sf.session_no = wk.step WHERE fly IS NOT NULL AND (wk.icao24, step) IN (SELECT (icao24, max(step)) FROM wk GROUP BY icao24)),
nw AS (SELECT icao24, w.*, row_number() OVER (PARTITION BY icao24, w.key ORDER BY step, nth) AS pos FROM (SELECT icao24, step, nth, w FROM ew)),
ow AS (SELECT *, max(CASE WHEN kind = 'o' THEN pos END) OVER (PARTITION BY icao24, key) AS opened, first_value(dep) OVER (PARTITION BY icao24, key ORDER BY pos) AS first_dep FROM nw),
aw AS (SELECT *, coalesce(sum((arr IS NOT NULL)::INT) OVER (PARTITION BY icao24, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM ow WHERE pos >= opened),
fw AS (SELECT icao24, key AS first_seen, max(until) FILTER (latest) AS last_seen, arg_max(cs, pos) FILTER (cs IS NOT NULL) AS callsign, any_value(first_dep) AS departure_airport_icao, max(arr) AS arrival_airport_icao,
 coalesce(bool_or(review) FILTER (arr IS NOT NULL), bool_or(review) FILTER (kind = 'o')) AS needs_review, string_agg(step, '' ORDER BY pos) AS path
 FROM (SELECT *, pos = max(pos) OVER (PARTITION BY icao24, key) AS latest FROM aw WHERE closed = 0) GROUP BY ALL)"""


FOUND = "SELECT icao24, callsign, departure_airport_icao, arrival_airport_icao, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, needs_review, path FROM fw"
o("s43_detect_flights", FOUND, features(15) + "," + walk("flight_seed", replay=False), recursive=True)
o("s54_replay_detector", FOUND, features(5) + "," + walk("flight_seed WHERE FALSE", replay=True), recursive=True)
o(
    "s51_incremental_detect",
    "SELECT mg.icao24, epoch_us(mg.first_seen) AS first_seen, CASE WHEN stale THEN coalesce(epoch_us(captured_at), epoch_us(mg.first_seen)) ELSE epoch_us(mg.last_seen) END AS last_seen, CASE WHEN stale THEN coalesce(lp.callsign, mg.callsign) ELSE mg.callsign END AS callsign, "
    "mg.departure_airport_icao, CASE WHEN stale THEN coalesce(CASE WHEN altitude_m < 500 AND km <= 8 THEN code END, 'UNKN') ELSE mg.arrival_airport_icao END AS arrival_airport_icao, stale OR mg.needs_review AS needs_review FROM mg LEFT JOIN lp ON lp.icao24 = mg.icao24 LEFT JOIN near USING (latitude, longitude)",
    features(15, "captured_at >= TIMESTAMP '2024-01-10'") + "," + walk("flight_seed", replay=False) + ", lp AS (SELECT icao24, callsign, captured_at, latitude, longitude, altitude_m FROM positions QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY captured_at DESC) = 1), "
    "mg AS (SELECT *, arrival_airport_icao IS NULL AND first_seen < TIMESTAMP '2024-01-30' AS stale FROM (SELECT icao24, first_seen, coalesce(u.last_seen, s.last_seen) AS last_seen, CASE WHEN u.path IS NULL THEN s.callsign ELSE u.callsign END AS callsign, CASE WHEN s.needs_review IS NULL THEN u.departure_airport_icao ELSE s.departure_airport_icao END AS departure_airport_icao, "
    "CASE WHEN u.path IS NULL THEN s.arrival_airport_icao ELSE u.arrival_airport_icao END AS arrival_airport_icao, coalesce(u.needs_review, s.needs_review) AS needs_review FROM flight_seed s FULL JOIN fw u USING (icao24, first_seen)))",
    recursive=True,
)
o("s50_covered_sessions", "SELECT icao24, session_no, epoch_us(first_at) AS first_at FROM (SELECT icao24, session_no, min(captured_at) AS first_at FROM s GROUP BY ALL) JOIN (SELECT icao24, last_seen FROM flight_seed WHERE arrival_airport_icao IS NOT NULL) USING (icao24) WHERE first_at <= last_seen", SESSIONS)
o("s52_close_stale", "SELECT f.icao24, epoch_us(first_seen) AS first_seen, epoch_us(coalesce(captured_at, first_seen)) AS last_seen, coalesce(CASE WHEN altitude_m < 500 AND km <= 8 THEN code END, 'UNKN') AS arrival_airport_icao, coalesce(p.callsign, f.callsign) AS callsign, TRUE AS needs_review FROM flight_seed f LEFT JOIN (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY captured_at DESC) = 1) p ON f.icao24 = p.icao24 LEFT JOIN near USING (latitude, longitude) WHERE arrival_airport_icao IS NULL AND first_seen < TIMESTAMP '2024-01-30'", NEAR)
o(
    "s53_backfill_open_flights",
    "SELECT icao24, epoch_us(opened) AS opened, action, callsign, dep AS departure_airport_icao, arr AS arrival_airport_icao, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, coalesce(dep = arr, FALSE) AS needs_review FROM "
    "(SELECT x.*, coalesce(f_dep, CASE WHEN nd.km <= 50 THEN nd.code END) AS dep, CASE WHEN na.km <= 50 THEN na.code END AS arr FROM x LEFT JOIN near nd ON nd.latitude = dlat AND nd.longitude = dlon LEFT JOIN near na ON na.latitude = alat AND na.longitude = alon)",
    f"{G}, {NEAR}, op AS (SELECT icao24, first_seen AS opened, callsign AS f_callsign, departure_airport_icao AS f_dep FROM flight_seed WHERE arrival_airport_icao IS NULL), "
    "lt AS (SELECT icao24, opened, max(captured_at) AS latest FROM g JOIN op USING (icao24) WHERE captured_at >= opened GROUP BY ALL), "
    "r0 AS (SELECT g.*, opened, f_callsign, f_dep, lag(ground) OVER (PARTITION BY icao24, opened ORDER BY captured_at) AS pg FROM g JOIN op USING (icao24) WHERE captured_at >= opened AND ground IS NOT NULL), "
    "ld AS (SELECT icao24, opened, min(captured_at) AS landed_at FROM r0 WHERE ground AND NOT pg GROUP BY ALL), "
    "r1 AS (SELECT r0.*, landed_at FROM r0 JOIN ld USING (icao24, opened) WHERE captured_at >= landed_at), "
    "r2 AS (SELECT icao24, opened, captured_at, latitude, longitude, callsign, ground, lag(ground) OVER w AS pg, lag(captured_at) OVER w AS pt, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(callsign) OVER w AS pcs FROM r1 WHERE captured_at > landed_at WINDOW w AS (PARTITION BY icao24, opened ORDER BY captured_at)), "
    # a take-off belongs to the first landing after it
    "ups AS (SELECT *, coalesce(callsign, pcs) AS up_cs FROM r2 WHERE pg AND NOT ground), downs AS (SELECT icao24, opened, captured_at AS down_at, latitude AS alat, longitude AS alon, callsign AS down_cs FROM r2 WHERE ground AND NOT pg), "
    "x AS (SELECT icao24, opened, 'close' AS action, coalesce(callsign, f_callsign) AS callsign, f_dep, opened AS first_seen, captured_at AS last_seen, NULL::DOUBLE AS dlat, NULL::DOUBLE AS dlon, latitude AS alat, longitude AS alon FROM r1 WHERE captured_at = landed_at "
    "UNION ALL SELECT icao24, opened, CASE WHEN down_at IS NULL THEN 'pending' ELSE 'new' END, coalesce(up_cs, down_cs), NULL, pt, coalesce(down_at, latest), plat, plon, alat, alon FROM (SELECT ups.*, down_at, alat, alon, down_cs FROM ups ASOF LEFT JOIN downs ON ups.icao24 = downs.icao24 AND ups.opened = downs.opened AND ups.captured_at < down_at) JOIN lt USING (icao24, opened))",
)
o("s54_compare_flights", "SELECT * FROM (SELECT icao24, coalesce(o, 0) AS old_flights, coalesce(orv, 0) AS old_review, coalesce(os, 0) AS old_same, coalesce(n, 0) AS new_flights, coalesce(nrv, 0) AS new_review, coalesce(ns, 0) AS new_same FROM (SELECT icao24, count(*) AS o, count(*) FILTER (needs_review) AS orv, count(*) FILTER (d = r AND d <> 'UNKN') AS os FROM a GROUP BY 1) FULL JOIN (SELECT icao24, count(*) AS n, count(*) FILTER (needs_review) AS nrv, count(*) FILTER (d = r AND d <> 'UNKN') AS ns FROM b GROUP BY 1) USING (icao24))", SIDES)
MERGED = f"SELECT * FROM (SELECT icao24, first_seen, coalesce(u.last_seen, f.last_seen) AS last_seen, CASE WHEN u.icao24 IS NULL THEN f.callsign ELSE u.callsign END AS callsign, CASE WHEN f.icao24 IS NULL THEN u.departure_airport_icao ELSE f.departure_airport_icao END AS departure_airport_icao, CASE WHEN u.icao24 IS NULL THEN f.arrival_airport_icao ELSE u.arrival_airport_icao END AS arrival_airport_icao, coalesce(u.needs_review, f.needs_review) AS needs_review FROM flights f FULL JOIN u USING (icao24, first_seen))"  # noqa: S608
o("s60_upsert_flights", f"SELECT {FK} FROM ({MERGED})", UPDATES)
ORACLES["s13_write_flights"] = ORACLES["s60_upsert_flights"]  # the same upsert, through the sink
o("s55_merge_flight_actions", f"SELECT {FK} FROM (SELECT m.icao24, m.first_seen, CASE WHEN g THEN u.last_seen ELSE m.last_seen END AS last_seen, CASE WHEN g THEN coalesce(u.callsign, m.callsign) ELSE m.callsign END AS callsign, m.departure_airport_icao, CASE WHEN g THEN coalesce(u.arrival_airport_icao, m.arrival_airport_icao) ELSE m.arrival_airport_icao END AS arrival_airport_icao, CASE WHEN g AND u.arrival_airport_icao IS NOT NULL THEN u.needs_review ELSE m.needs_review END AS needs_review FROM (SELECT m.*, m.arrival_airport_icao IS NULL AND u0.icao24 IS NOT NULL AS g FROM ({MERGED.replace(' u USING', ' v AS u USING')}) m LEFT JOIN (SELECT DISTINCT icao24, first_seen FROM u) u0 USING (icao24, first_seen)) m LEFT JOIN u USING (icao24, first_seen))", UPDATES + ", v AS (SELECT * FROM u WHERE arrival_airport_icao IS NULL)")
o("s61_update_open_flights", f"SELECT {FK} FROM (SELECT f.icao24, f.first_seen, CASE WHEN g THEN u.last_seen ELSE f.last_seen END AS last_seen, CASE WHEN g THEN coalesce(u.callsign, f.callsign) ELSE f.callsign END AS callsign, f.departure_airport_icao, CASE WHEN g THEN u.arrival_airport_icao ELSE f.arrival END AS arrival_airport_icao, CASE WHEN g AND u.arrival_airport_icao IS NOT NULL THEN u.needs_review ELSE f.needs_review END AS needs_review FROM (SELECT f.*, CASE WHEN id % 5 > 0 THEN arrival_airport_icao END AS arrival, (CASE WHEN id % 5 > 0 THEN arrival_airport_icao END) IS NULL AND w.icao24 IS NOT NULL AS g FROM flights f LEFT JOIN (SELECT icao24, first_seen FROM u) w USING (icao24, first_seen)) f LEFT JOIN u USING (icao24, first_seen))", UPDATES)
o("s12_flight_page_counts", "SELECT count(*) FILTER (id % 7 > 0 AND id % 5 > 0) AS registered, count(*) FILTER (id % 7 = 0 OR id % 5 = 0) AS unregistered FROM flights JOIN aircraft USING (icao24)")
o("s62_changed_departures", "SELECT count(*) AS changed FROM flights f JOIN u USING (icao24, first_seen) WHERE f.departure_airport_icao IS NULL", UPDATES)
o("s69_fleet_totals", "SELECT count(*) FILTER (side <> 'fleet') AS external, count(*) FILTER (side <> 'external') AS fleet, count(*) FILTER (side = 'both') AS both, count(*) FILTER (side = 'external') AS only_external, count(*) FILTER (side = 'fleet') AS only_fleet, count(*) FILTER (mismatch) AS mismatches, count(*) FILTER (fillable) AS fillable, count(*) FILTER (reactivate) AS reactivations FROM df", EXTERNAL)
o("s62_fill_departure", f"SELECT {FK} FROM (SELECT f.icao24, f.first_seen, f.last_seen, f.callsign, coalesce(f.departure_airport_icao, u.departure_airport_icao) AS departure_airport_icao, f.arrival_airport_icao, f.needs_review FROM flights f LEFT JOIN u USING (icao24, first_seen))", UPDATES)
o("s63_upsert_aircraft", "SELECT icao24, coalesce(u.registration, a.registration) AS registration, CASE WHEN u.registration IS NULL THEN a.aircraft_type ELSE u.aircraft_type END AS aircraft_type, coalesce(u.aircraft_subtype, a.aircraft_subtype) AS aircraft_subtype, u.registration IS NOT NULL OR a.is_active AS is_active, CASE WHEN u.registration IS NULL THEN a.needs_review ELSE FALSE END AS needs_review FROM aircraft a FULL JOIN (SELECT CASE WHEN icao24 < '000400' THEN icao24 ELSE 'x' || icao24 END AS icao24, 'D-UPS' AS registration, aircraft_type, 'up' AS aircraft_subtype FROM aircraft WHERE NOT is_active) u USING (icao24)")
o("s64_discover_aircraft", "SELECT icao24, coalesce(r.registration, upper(icao24)) AS registration, CASE WHEN r.registration IS NOT NULL THEN r.aircraft_type ELSE t.t END AS aircraft_type, CASE WHEN r.registration IS NOT NULL THEN r.aircraft_subtype ELSE t.s END AS aircraft_subtype, CASE WHEN r.registration IS NOT NULL THEN r.aircraft_type ELSE t.t END IS NULL OR coalesce(r.registration, upper(icao24)) = upper(icao24) AS needs_review FROM n LEFT JOIN (SELECT * FROM x WHERE (SELECT count(DISTINCT icao24) FROM x) < (SELECT count(*) FROM n) OR row_no <= (SELECT max(m) FROM (SELECT min(row_no) AS m FROM x GROUP BY icao24)) QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY row_no DESC) = 1) r USING (icao24) LEFT JOIN (SELECT icao24, 'LOOK' AS t, aircraft_subtype AS s FROM aircraft WHERE aircraft_subtype IS NOT NULL) t USING (icao24)", REGISTER + ", n AS (SELECT DISTINCT icao24 FROM positions WHERE icao24 NOT IN (SELECT icao24 FROM aircraft WHERE is_active)), x AS (SELECT * FROM cr WHERE icao24 IN (SELECT icao24 FROM n))")
o("s65_reactivate_seen", "SELECT icao24, is_active OR icao24 IN (SELECT icao24 FROM seen) AS is_active FROM aircraft", SEEN)
o("s66_refresh_aircraft", "SELECT a.icao24, CASE WHEN g THEN coalesce(nullif(a.registration, a.icao24), r.registration, a.registration) ELSE a.registration END AS registration, CASE WHEN g THEN coalesce(a.aircraft_type, r.aircraft_type, CASE WHEN l.icao24 IS NOT NULL THEN 'LOOK' END) ELSE a.aircraft_type END AS aircraft_type, CASE WHEN g THEN coalesce(a.aircraft_subtype, r.aircraft_subtype, CASE WHEN a.aircraft_type IS NULL AND r.aircraft_type IS NULL THEN l.aircraft_subtype END) ELSE a.aircraft_subtype END AS aircraft_subtype, a.is_active FROM (SELECT *, is_active AND icao24 IN (SELECT icao24 FROM al) AS g FROM aircraft) a LEFT JOIN al r USING (icao24) LEFT JOIN (SELECT icao24, aircraft_subtype FROM aircraft WHERE aircraft_subtype IS NOT NULL) l USING (icao24)", AIRLINE)
o("s67_retire_missing", "SELECT icao24, is_active AND NOT x AS is_active, CASE WHEN x THEN '2024-01-31' END AS last_seen_date FROM (SELECT *, is_active AND icao24 NOT IN (SELECT icao24 FROM al) AND icao24 NOT IN (SELECT icao24 FROM seen) AS x FROM aircraft)", AIRLINE + ", " + SEEN)
o("s68_fleet_sanity_guard", "SELECT icao24, rule FROM al", AIRLINE)
o("s69_compare_fleets", "SELECT * FROM df", EXTERNAL)
o("s70_apply_fleet_fixes", "SELECT a.icao24, CASE WHEN df.fillable THEN coalesce(a.aircraft_type, their_type) ELSE a.aircraft_type END AS aircraft_type, a.is_active OR coalesce(df.reactivate, FALSE) AS is_active FROM aircraft a LEFT JOIN df USING (icao24)", EXTERNAL)
o("s71_rebuild_fleet", "SELECT x.registration, l.icao24, coalesce(x.t, l.aircraft_type) AS aircraft_type, l.aircraft_subtype, l.icao24 IS NULL AS skipped, coalesce(x.t, l.aircraft_type) IS NULL OR coalesce(x.registration = upper(l.icao24), FALSE) AS needs_review FROM x LEFT JOIN l USING (registration)", REGISTER + ", x AS (SELECT upper(registration) AS registration, CASE WHEN row_no % 5 > 0 THEN 'EXTT' END AS t FROM registry WHERE row_no % 3 <> 0 AND registration NOT IN ('', 'D-ADUP')), l AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY registration ORDER BY row_no DESC) = 1)")
o("s72_compare_flight_sets", "SELECT icao24, sum(x)::BIGINT AS n_a, sum(y)::BIGINT AS n_b, sum(x * y)::BIGINT AS n_both, sum(x * (1 - y))::BIGINT AS only_a, sum(y * (1 - x))::BIGINT AS only_b, CASE WHEN sum(x * (1 - y)) = 0 AND sum(y * (1 - x)) = 0 THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM (SELECT icao24, first_seen, last_seen, d, r, max(x) AS x, max(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY ALL) GROUP BY 1", SIDES)
o("s73_apply_review", "SELECT icao24 AS key, CASE WHEN act = 0 THEN coalesce(ed.registration, a.registration) ELSE a.registration END AS registration, CASE WHEN act = 0 THEN coalesce(type, aircraft_type) ELSE aircraft_type END AS aircraft_type, needs_review AND coalesce(act, 9) > 1 AS needs_review FROM aircraft a LEFT JOIN ed ON kind = 'aircraft' AND key = icao24 UNION ALL SELECT id::VARCHAR, CASE WHEN act = 0 THEN coalesce(dep, departure_airport_icao) ELSE departure_airport_icao END, CASE WHEN act = 0 THEN coalesce(arr, arrival_airport_icao) ELSE arrival_airport_icao END, needs_review AND coalesce(act, 9) > 1 FROM flights LEFT JOIN ed ON kind = 'flight' AND key = id::VARCHAR", EDITS)
o("s74_backfill_review_flag", "SELECT icao24, aircraft_type IS NULL OR registration = upper(icao24) AS needs_review FROM aircraft")
o("s75_expire_positions", "SELECT icao24, count(*) AS n FROM positions WHERE captured_at >= TIMESTAMP '2024-01-21' GROUP BY 1")
o("s76_insert_and_delete", "SELECT id::VARCHAR AS key, 'inserted' AS what FROM flights WHERE id % 2 > 0 AND icao24 IN (SELECT icao24 FROM aircraft WHERE is_active) AND (icao24, first_seen) NOT IN (SELECT (icao24, first_seen) FROM flights WHERE id % 2 = 0) UNION ALL SELECT icao24, 'left' FROM aircraft WHERE is_active OR icao24 IN (SELECT icao24 FROM flights WHERE id % 5 = 0)")
o("s56_stream_positions", f"SELECT icao24, epoch_us(date_trunc('second', captured_at)) AS captured_at, nullif(upper({STRIP.format('callsign')}), '') AS callsign FROM positions")
o("s57_stream_sessions", "SELECT icao24, epoch_us(min(captured_at)) AS first_seen, epoch_us(max(captured_at)) AS last_seen, count(*) AS n, arg_min(cs, captured_at) FILTER (cs IS NOT NULL) AS callsign FROM s GROUP BY icao24, session_no", SESSIONS)
o("s59_stream_activity", "SELECT epoch_us(time_bucket(INTERVAL 2 MINUTE, captured_at)) AS window_start, count(DISTINCT icao24) AS seen, count(DISTINCT icao24) FILTER (NOT on_ground) AS airborne FROM positions GROUP BY 1")
o("s77_job_run_record", "SELECT 'flight_detector' AS run_type, epoch_us(TIMESTAMP '2001-08-01') AS started_at, epoch_us(TIMESTAMP '2024-01-31') AS finished_at, count(*)::INT AS aircraft_total, count(*) FILTER (NOT needs_review)::INT AS aircraft_ok, count(*) FILTER (needs_review)::INT AS aircraft_error, count(arrival_airport_icao)::INT AS flights_upserted, 'none' AS error_detail, 'ok' AS status FROM flights")
o("s77_audited_runs", "SELECT 'flight_detector' AS run_type, epoch_us(TIMESTAMP '2001-08-01') AS started_at, 0 AS aircraft_error, count(*)::INT AS flights_upserted, 'none' AS error_detail, 'ok' AS status FROM flights UNION ALL SELECT 'fleet_refresh', epoch_us(TIMESTAMP '2001-08-01'), count(*) FILTER (needs_review)::INT, 0, 'flights to be reviewed', 'error' FROM flights")
o("s78_fleet_counts", "SELECT count(*) FILTER (is_active) AS active, count(*) AS total, count(*) FILTER (NOT is_active) AS retired FROM aircraft")
GOOD = "departure_airport_icao IS NOT NULL AND NOT needs_review"
o("s79_flight_counts", f'SELECT count(*) FILTER ({GOOD} AND flight_date = DATE \'2001-08-01\') AS today, count(*) FILTER ({GOOD} AND flight_date >= DATE \'2001-07-25\') AS week, count(*) FILTER ({GOOD}) AS "all", count(*) FILTER (arrival_airport_icao IS NULL) AS pending FROM flights')
o("s80_recent_errors", "SELECT id, run_type, status, epoch_us(started_at) AS started_at FROM batch_runs WHERE status <> 'ok' AND started_at >= TIMESTAMP '2024-01-29'")
o("s81_airborne_now", "SELECT count(DISTINCT icao24) AS airborne FROM positions WHERE NOT on_ground AND date_trunc('day', captured_at) = (SELECT max(date_trunc('day', captured_at)) FROM positions)")
o("s82_poll_age_minutes", "SELECT round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(captured_at))) / 60000000)::BIGINT AS age_minutes FROM positions")
o("s83_last_run_per_type", "SELECT run_type, id, status, epoch_us(started_at) AS started_at FROM lr", LAST_RUNS)
o("s84_health_status", "SELECT run_type, CASE run_type WHEN 'state_poller' THEN CASE WHEN status = 'ok' AND (SELECT round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(captured_at))) / 60000000) FROM positions) <= 10 THEN 'green' WHEN id IS NOT NULL THEN 'amber' ELSE 'red' END WHEN 'flight_detector' THEN CASE WHEN status = 'ok' THEN 'green' ELSE 'red' END ELSE CASE WHEN NOT coalesce(TIMESTAMP '2024-01-31' - started_at < CASE run_type WHEN 'fleet_discovery' THEN INTERVAL 7 HOUR ELSE INTERVAL 192 HOUR END, FALSE) THEN 'amber' WHEN status = 'ok' THEN 'green' ELSE 'red' END END AS health FROM lr", LAST_RUNS)
o("s85_type_overlay", "SELECT coalesce(aircraft_type, 'unknown') AS aircraft_type, count(*) AS n, count(*) FILTER (fl) AS flew, round(count(*) FILTER (fl) / count(*), 6) AS share FROM (SELECT *, icao24 IN (SELECT icao24 FROM flights WHERE NOT needs_review AND flight_date >= DATE '2001-07-25') AS fl FROM aircraft WHERE is_active) GROUP BY 1")
o("s86_top_routes", "SELECT departure_airport_icao, arrival_airport_icao, count(*) AS n FROM flights WHERE NOT needs_review AND departure_airport_icao IS NOT NULL AND arrival_airport_icao IS NOT NULL AND flight_date >= DATE '2001-08-01' - 300 GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 20")
o("s87_flights_per_day", "SELECT CAST(flight_date AS VARCHAR) AS flight_date, count(*) AS n_flights, count(DISTINCT callsign) FILTER (trim(callsign) <> '') AS n_callsigns FROM flights WHERE NOT needs_review AND flight_date >= DATE '2001-08-01' - 13 GROUP BY 1")
o("s88_fleet_list", "SELECT a.icao24, count(f.id) AS total_flights, count(*) FILTER (flight_date >= DATE '2024-01-22') AS flights_7d, CAST(max(flight_date) AS VARCHAR) AS last_flight_date, a.icao24 IN (SELECT icao24 FROM positions WHERE captured_at >= TIMESTAMP '2024-01-29 11:55:00') AS currently_tracking FROM aircraft a LEFT JOIN flights f ON a.icao24 = f.icao24 GROUP BY a.icao24")
o("s89_fleet_filter_sort", "SELECT icao24 FROM aircraft WHERE is_active AND aircraft_type = 'MACH' AND (registration || ' ' || icao24 || ' ' || aircraft_type || ' ' || coalesce(aircraft_subtype, 'null')) ILIKE '%d-00%' UNION ALL SELECT DISTINCT aircraft_type FROM aircraft WHERE aircraft_type IS NOT NULL")
o("s90_aircraft_totals", "SELECT icao24, count(*) AS total, count(*) FILTER (flight_date >= DATE '2001-07-25') AS last_7d, count(*) FILTER (flight_date >= DATE '2001-08-01' - 30) AS last_30d FROM flights GROUP BY 1")
o("s90_aircraft_last_flights", "SELECT icao24, row_number() OVER (PARTITION BY icao24 ORDER BY first_seen DESC, id)::INT AS nth, id, coalesce(departure_airport_icao, '?') || '-' || coalesce(arrival_airport_icao, '?') AS route, arrival_airport_icao IS NULL AS pending FROM flights WHERE departure_airport_icao IS NOT NULL QUALIFY nth <= 100")
o("s90_aircraft_top_routes", "SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY n DESC, route)::INT AS nth FROM (SELECT icao24, departure_airport_icao || '-' || arrival_airport_icao AS route, count(*) AS n FROM flights WHERE departure_airport_icao IS NOT NULL AND arrival_airport_icao IS NOT NULL GROUP BY ALL) QUALIFY nth <= 20")
o("s90_aircraft_per_day", "SELECT icao24, CAST(flight_date AS VARCHAR) AS flight_date, count(*) AS n FROM flights WHERE flight_date >= DATE '2001-08-01' - 29 GROUP BY 1, 2")
o("s91_flights_page", "SELECT id, (SELECT count(*) FROM m) AS total, ceil((SELECT count(*) FROM m) / 20)::BIGINT AS pages FROM m ORDER BY first_seen DESC, id LIMIT 20 OFFSET 20", "m AS (SELECT * FROM flights WHERE callsign ILIKE '%dlh1%' AND departure_airport_icao = 'A001' AND NOT needs_review)")
o("s92_review_queue", "SELECT icao24 AS key, registration FROM aircraft WHERE needs_review UNION ALL SELECT id::VARCHAR, registration FROM flights f JOIN aircraft a USING (icao24) WHERE f.needs_review")
o("s93_rotation_timeline", "SELECT registration, id, route, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, CASE route WHEN 'A001-A002' THEN 'focus' WHEN 'A002-A001' THEN 'reverse' ELSE 'other' END AS kind FROM fr WHERE flight_date >= DATE '2001-08-01' - 400", FLOWN)
o("s94_dow_heatmap", "SELECT registration, " + ", ".join(f"coalesce(max(i) FILTER (dow = {d}), 0.0) AS d{d}" for d in range(7)) + " FROM (SELECT registration, dow, round(n / max(n) OVER (), 6) AS i FROM (SELECT registration, dayofweek(first_seen) AS dow, count(*) AS n FROM fo GROUP BY ALL)) GROUP BY 1", FLOWN)
o("s95_cycle_lengths", "SELECT registration, string_agg(gap, ',' ORDER BY gap) AS gaps FROM gp GROUP BY 1", GAPS)
o("s96_cycle_histogram", "SELECT (gap // width) * width AS bin, width, count(*) AS n FROM gp, (SELECT CASE WHEN max(gap) <= 30 THEN 1 WHEN max(gap) <= 60 THEN 2 ELSE 5 END AS width FROM gp) GROUP BY ALL", GAPS)
o("s97_cycle_summary", "SELECT *, CASE WHEN average <= 7 THEN 'week' WHEN average <= 14 THEN 'two weeks' WHEN average <= 21 THEN 'three weeks' ELSE 'more' END AS class FROM (SELECT registration, round(sum(gap) / count(*), 1) AS average, count(*) AS n FROM gp GROUP BY 1)", GAPS)
o("s98_route_transitions", "SELECT * FROM tr", TRANS)
o("s99_transition_probabilities", "SELECT *, round(n / sum(n) OVER (PARTITION BY from_route), 6) AS share FROM tr", TRANS)
AFFINITY = "SELECT *, round(n / max(n) OVER (), 6) AS intensity FROM (SELECT registration, route, count(*) AS n FROM fr WHERE route IN (SELECT route FROM fr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) GROUP BY ALL)"
o("s100_route_affinity", AFFINITY, FLOWN)
o("s100_affinity_matrix", f"SELECT registration, route, coalesce(intensity, 0) AS intensity FROM (SELECT DISTINCT registration FROM ({AFFINITY})) CROSS JOIN (SELECT DISTINCT route FROM ({AFFINITY})) LEFT JOIN ({AFFINITY}) USING (registration, route)", FLOWN)
o("s101_preceding_routes", "SELECT step, earlier, count(*) AS n FROM (SELECT 1 AS step, r1 AS earlier FROM w WHERE route = 'A001-A002' UNION ALL SELECT 2, r2 FROM w WHERE route = 'A001-A002' UNION ALL SELECT 3, r3 FROM w WHERE route = 'A001-A002') WHERE earlier IS NOT NULL GROUP BY ALL", FLOWN + ", w AS (SELECT *, lag(route, 1) OVER z AS r1, lag(route, 2) OVER z AS r2, lag(route, 3) OVER z AS r3 FROM fr WINDOW z AS (PARTITION BY icao24 ORDER BY first_seen, id))")
o("s102_last_known_airport", "SELECT registration, arrival_airport_icao AS airport, epoch_us(last_seen) AS last_seen FROM fr WHERE is_active QUALIFY row_number() OVER (PARTITION BY registration ORDER BY last_seen DESC, id DESC) = 1", FLOWN)
o("s103_focus_route_history", "SELECT id, registration, callsign, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, duration_minutes FROM fl WHERE route = 'A001-A002'", FLOWN)
