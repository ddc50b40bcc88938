"""DuckDB SQL that states each registered query independently of the DataFrame code."""

from __future__ import annotations

import math

from fieldtrace.plans.layers import PADDOCKS, RESOURCES
from fieldtrace.sources.fixes import FIX_COLUMNS, HOT_COLUMNS, SHARED_TIME, dirty_sql, select_sql

HOT = f"fixes AS ({select_sql(HOT_COLUMNS)})"
FIXES, HOURLY, DIRTY = f"fixes AS ({select_sql(FIX_COLUMNS)})", f"fixes AS ({select_sql(SHARED_TIME)})", f"fixes AS ({dirty_sql()})"
TRACK = "deployment_id, sensor_id"
ANIMAL = "deployment_id, animal_id, sensor_id"
EPOCH = "epoch, epoch_start, epoch_end, epoch_mins"


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2))"
    return f"(2*6371000.0e0*atan2(sqrt({a}), sqrt(1-{a})))"


def _bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    y = f"sin(radians({lon2})-radians({lon1}))*cos(radians({lat2}))"
    x = f"cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))*cos(radians({lon2})-radians({lon1}))"
    return f"((degrees(atan2({y}, {x}))+360) % 360)"


def _epoch(level: str, mins: float | None = None, ts: str = "datetime") -> str:
    if level == "interval":
        us = int(mins * 60e6)
        start = f"make_timestamp(CAST(floor(epoch_us({ts})/{us}.0e0) AS BIGINT)*{us})"
        return f"strftime({start}, '%Y-%m-%d %H:%M:%S') AS epoch, {start} AS epoch_start, {start} + INTERVAL {int(mins)} MINUTE AS epoch_end, CAST({mins} AS DOUBLE) AS epoch_mins"
    fmt = {"day": "%Y-%m-%d", "hour": "%Y-%m-%d %H:00:00", "week": "%G-W%V", "month": "%Y-%m"}[level]
    start = f"CAST(date_trunc('{level}', {ts}) AS TIMESTAMP)"
    end = f"{start} + INTERVAL 1 {level}"
    return f"strftime({ts}, '{fmt}') AS epoch, {start} AS epoch_start, CAST({end} AS TIMESTAMP) AS epoch_end, (epoch_us(CAST({end} AS TIMESTAMP))-epoch_us({start}))/60e6 AS epoch_mins"


def _steps(source: str = "fixes", part: str = TRACK, along: str = TRACK, columns: str = "") -> str:
    w = f"(PARTITION BY {part} ORDER BY datetime, order_col)"
    return f"""
lagged AS (
  SELECT *, lag(datetime) OVER {w} AS p_t, lag(lon) OVER {w} AS p_lon, lag(lat) OVER {w} AS p_lat, first_value(lon) OVER {w} AS f_lon, first_value(lat) OVER {w} AS f_lat FROM {source}
), measured AS (
  SELECT *, (epoch_us(datetime)-epoch_us(p_t))/1e6 AS step_dt_s, {_hav('p_lon', 'p_lat', 'lon', 'lat')} AS step_m, {_bearing('p_lon', 'p_lat', 'lon', 'lat')} AS bearing_deg, {_hav('f_lon', 'f_lat', 'lon', 'lat')} AS net_displacement_m FROM lagged
), steps AS (
  SELECT *, CASE WHEN step_dt_s > 0 THEN step_m/step_dt_s END AS speed_mps,
    abs(((((bearing_deg - lag(bearing_deg) OVER {w}) + 180) % 360) + 360) % 360 - 180)*pi()/180 AS turn_rad,
    sum(coalesce(step_m, 0)) OVER (PARTITION BY {along} ORDER BY datetime, order_col ROWS UNBOUNDED PRECEDING) AS cum_distance_m
  FROM measured
)"""


def steps() -> str:
    return f"WITH {FIXES}, {_steps()} SELECT *, turn_rad*180/pi() AS turn_deg FROM steps"


def _segments(mins: float, source: str = "fixes") -> str:
    w = f"(PARTITION BY {TRACK} ORDER BY order_col)"
    return f"""
gaps AS (SELECT *, (epoch_us(datetime)-epoch_us(lag(datetime) OVER {w}))/60e6 AS gap FROM {source}),
segmented AS (SELECT *, sensor_id || '_seg' || lpad(CAST(sum(CASE WHEN gap IS NULL OR gap < 0 OR gap > {mins} THEN 1 ELSE 0 END) OVER {w} AS VARCHAR), 3, '0') AS segment_id FROM gaps)"""


def segments(mins: float) -> str:
    return f"WITH {DIRTY}, {_segments(mins)} SELECT * FROM segmented"


def steps_in_segments() -> str:
    return f"WITH {FIXES}, {_segments(1440)}, {_steps('segmented', TRACK + ', segment_id')} SELECT * FROM steps"


def _movement(level: str, mins: float | None, groups: list[str], meta: list[str] = (), source: str = "fixes") -> str:
    g = ", ".join(groups)
    by = f"{g}, {EPOCH}"
    return f"""{_steps(source, g, g)},
dated AS (SELECT *, {_epoch(level, mins)} FROM steps),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY datetime, order_col) AS rn FROM dated),
masked AS (SELECT *, CASE WHEN rn > 1 THEN step_m END AS st, CASE WHEN rn > 1 THEN speed_mps END AS sp, CASE WHEN rn > 2 THEN turn_rad END AS tu FROM numbered),
summed AS (
  SELECT {by}, {''.join(f'CASE WHEN min({m}) = max({m}) THEN min({m}) END AS {m}, ' for m in meta)} count(*) AS n_fixes, count(st) AS n_steps, min(datetime) AS start_datetime, max(datetime) AS end_datetime,
    (epoch_us(max(datetime))-epoch_us(min(datetime)))/1e6 AS span_s, sum(st) AS total_distance_m, arg_min(lon, rn) AS lon1, arg_min(lat, rn) AS lat1, arg_max(lon, rn) AS lon2, arg_max(lat, rn) AS lat2,
    avg(st) AS mean_step_m, quantile_cont(st, 0.5) AS median_step_m, quantile_cont(st, 0.95) AS p95_step_m, avg(sp) AS mean_speed_mps, max(sp) AS max_speed_mps, quantile_cont(sp, 0.95) AS p95_speed_mps, avg(tu) AS mean_abs_turn_rad
  FROM masked GROUP BY {by}
), netted AS (SELECT *, CASE WHEN n_fixes >= 2 THEN {_hav('lon1', 'lat1', 'lon2', 'lat2')} END AS net_displacement_m FROM summed),
moved AS (SELECT *, CASE WHEN total_distance_m > 0 THEN net_displacement_m/total_distance_m END AS straightness_index FROM netted)"""


def movement(level: str, mins: float | None, groups: list[str], meta: list[str] = ()) -> str:
    return f"WITH {FIXES}, {_movement(level, mins, groups, meta)} SELECT * FROM moved"


_BAD_SENSOR = "(sensor_id IS NULL OR trim(sensor_id) = '')"
_BAD_LON, _BAD_LAT = "coalesce(lon NOT BETWEEN -180 AND 180, false)", "coalesce(lat NOT BETWEEN -90 AND 90, false)"
_ZERO = "coalesce(lon = 0 AND lat = 0, false)"


def invalid_rows() -> str:
    reasons = [("missing_sensor_id", _BAD_SENSOR), ("invalid_datetime", "datetime IS NULL"), ("missing_lon", "lon IS NULL"), ("missing_lat", "lat IS NULL"), ("invalid_lon", _BAD_LON), ("invalid_lat", _BAD_LAT), ("zero_zero", _ZERO)]
    text = "concat_ws(';', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in reasons) + ")"
    return f"WITH {DIRTY} SELECT * FROM (SELECT *, {text} AS invalid_reason FROM fixes) x WHERE invalid_reason <> ''"


def validated_rows() -> str:
    return f"WITH {DIRTY} SELECT * FROM fixes WHERE NOT {_BAD_SENSOR} AND datetime IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90"


def _intervals(mins: float) -> str:
    w = f"(PARTITION BY {TRACK} ORDER BY order_col)"
    return f"""timed AS (SELECT * FROM fixes WHERE datetime IS NOT NULL),
lags AS (SELECT {TRACK}, lag(order_col) OVER {w} AS previous_row_id, order_col AS row_id, lag(datetime) OVER {w} AS p_t, datetime FROM timed),
intervals AS (SELECT *, (epoch_us(datetime)-epoch_us(p_t))/1e6 AS interval_s, (epoch_us(datetime)-epoch_us(p_t))/60e6 AS interval_mins FROM lags WHERE p_t IS NOT NULL)"""


def check_gaps(mins: float) -> str:
    return f"WITH {DIRTY}, {_intervals(mins)} SELECT *, CASE WHEN interval_s < 0 THEN 'negative' WHEN interval_s = 0 THEN 'zero' ELSE 'large_gap' END AS interval_type FROM intervals WHERE interval_mins > {mins} OR interval_s <= 0"


def qc_gap_rows(mins: float) -> str:
    return f"""WITH {DIRTY}, {_intervals(mins)}, large AS (SELECT *, row_number() OVER (ORDER BY deployment_id NULLS FIRST, sensor_id NULLS FIRST, row_id) AS gap_id FROM intervals WHERE interval_mins > {mins}),
sides AS (SELECT gap_id, interval_mins AS gap_mins, 'before' AS gap_side, previous_row_id AS row_id FROM large UNION ALL SELECT gap_id, interval_mins, 'after', row_id FROM large)
SELECT s.*, f.deployment_id, f.sensor_id FROM sides s JOIN fixes f ON f.order_col = s.row_id"""


_RECORD = "sensor_id, animal_id, deployment_id, datetime, lon, lat, treatment, state"


def _duplicates() -> str:
    return f"""twins AS (SELECT *, row_number() OVER (PARTITION BY {_RECORD} ORDER BY order_col) > 1 AS duplicate_record,
  NOT {_BAD_SENSOR} AND datetime IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND row_number() OVER (PARTITION BY {TRACK}, datetime, lon, lat ORDER BY order_col) > 1 AS duplicate_fix FROM fixes)"""


def duplicate_rows() -> str:
    return f"WITH {DIRTY}, {_duplicates()} SELECT * FROM twins WHERE duplicate_record OR duplicate_fix"


def qc_metrics(mins: float) -> str:
    w = f"(PARTITION BY {TRACK} ORDER BY order_col)"
    flags = {
        "n_missing_sensor_id": _BAD_SENSOR, "n_missing_animal_id": "(animal_id IS NULL OR trim(animal_id) = '')", "n_invalid_datetime": "datetime IS NULL", "n_missing_lon": "lon IS NULL", "n_missing_lat": "lat IS NULL",
        "n_missing_coordinates": "(lon IS NULL OR lat IS NULL)", "n_invalid_lon": f"(lon IS NULL OR {_BAD_LON})", "n_invalid_lat": f"(lat IS NULL OR {_BAD_LAT})", "n_invalid_coordinates": f"(lon IS NULL OR lat IS NULL OR {_BAD_LON} OR {_BAD_LAT})",
        "n_invalid_rows": f"({_BAD_SENSOR} OR datetime IS NULL OR lon IS NULL OR lat IS NULL OR {_BAD_LON} OR {_BAD_LAT})", "n_zero_zero": "false",
    }
    one = ", ".join(f"count(*) FILTER (WHERE {t}) AS {n}" for n, t in flags.items())
    rows = ["('n_rows', n, 1, NULL, NULL, NULL)", "('n_fixes', n, 1, NULL, NULL, NULL)", "('n_sensors', n_sensors, NULL, NULL, NULL, NULL)", "('n_animals', n_animals, NULL, NULL, NULL, NULL)", "('datetime_min', NULL, NULL, NULL, t0, NULL)", "('datetime_max', NULL, NULL, NULL, t1, NULL)"]
    rows += [f"('{n}', {n}, {n}/n, NULL, NULL, NULL)" for n in [*flags, "n_duplicate_fixes", "n_duplicate_records", "n_out_of_order"]]
    rows += ["('n_intervals', n_intervals, n_intervals/(n-1), NULL, NULL, NULL)"]
    rows += [f"('interval_{k}_s', NULL, NULL, i_{k}, NULL, NULL)" for k in ("min", "q25", "median", "mean", "q75", "max")]
    rows += ["('n_non_positive_intervals', n_low, n_low/n_intervals, NULL, NULL, NULL)", f"('n_large_gaps', n_large, n_large/n_intervals, NULL, NULL, {mins})"]
    return f"""WITH {DIRTY}, {_intervals(mins)}, {_duplicates()},
late AS (SELECT datetime < lag(datetime) OVER {w} AS late FROM fixes),
one AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT nullif(trim(sensor_id), '')) AS n_sensors, count(DISTINCT nullif(trim(animal_id), '')) AS n_animals, min(datetime) AS t0, max(datetime) AS t1, {one} FROM fixes),
two AS (SELECT count(*) FILTER (WHERE duplicate_fix) AS n_duplicate_fixes, count(*) FILTER (WHERE duplicate_record) AS n_duplicate_records FROM twins),
three AS (SELECT count(*) FILTER (WHERE late) AS n_out_of_order FROM late),
four AS (SELECT CAST(count(*) AS DOUBLE) AS n_intervals, min(interval_s) AS i_min, quantile_cont(interval_s, 0.25) AS i_q25, quantile_cont(interval_s, 0.5) AS i_median, avg(interval_s) AS i_mean, quantile_cont(interval_s, 0.75) AS i_q75, max(interval_s) AS i_max,
  count(*) FILTER (WHERE interval_s <= 0) AS n_low, count(*) FILTER (WHERE interval_mins > {mins}) AS n_large FROM intervals),
every AS (SELECT * FROM one, two, three, four)
{" UNION ALL ".join(f"SELECT {a} AS metric, CAST({b} AS DOUBLE) AS count, CAST({c} AS DOUBLE) AS proportion, CAST({d} AS DOUBLE) AS value, CAST({e} AS TIMESTAMP) AS datetime_value, CAST({f} AS DOUBLE) AS threshold_mins FROM every" for a, b, c, d, e, f in (r[1:-1].split(", ") for r in rows))}"""


_UNIQUE = "unique_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, datetime, lon, lat ORDER BY order_col) AS k FROM fixes) x WHERE k = 1)"


def clean_duplicates() -> str:
    return f"WITH {DIRTY}, {_UNIQUE} SELECT * FROM unique_rows"


_COORD = "(lon IS NULL OR lat IS NULL OR lon NOT BETWEEN -180 AND 180 OR lat NOT BETWEEN -90 AND 90)"


def clean_errors(start: str, end: str) -> str:
    text = f"concat_ws(';', CASE WHEN {_BAD_SENSOR} THEN 'missing_sensor_id' END, CASE WHEN datetime IS NULL THEN 'invalid_datetime' END, CASE WHEN {_COORD} THEN 'invalid_coordinate' END, CASE WHEN {_ZERO} THEN 'zero_zero' END, CASE WHEN datetime < TIMESTAMP '{start} 00:00:00' OR datetime > TIMESTAMP '{end} 00:00:00' THEN 'outside_deployment_window' END)"
    return f"WITH {DIRTY} SELECT *, gps_error_reason <> '' AS is_gps_error FROM (SELECT *, {text} AS gps_error_reason FROM fixes) x"


def clean_windows() -> str:
    rows = ", ".join(f"('D{k}', TIMESTAMP '2024-01-{5 + k:02d} 00:00:00', TIMESTAMP '2024-01-{25 - k:02d} 12:00:00')" for k in range(3))
    text = "concat_ws(';', CASE WHEN w.a IS NULL THEN 'missing_deployment_window' END, CASE WHEN f.datetime < w.a OR f.datetime > w.b THEN 'outside_deployment_window' END)"
    return f"WITH {FIXES}, w(d, a, b) AS (VALUES {rows}) SELECT *, gps_error_reason <> '' AS is_gps_error FROM (SELECT f.order_col, {text} AS gps_error_reason FROM fixes f LEFT JOIN w ON w.d = f.deployment_id) x"


def clean_speed(limit: str) -> str:
    return f"WITH {FIXES}, {_steps()} SELECT order_col, coalesce(speed_mps > {limit}, false) AS is_speed_outlier FROM steps"


def clean_speed_quantile(p: float, least: float) -> str:
    return f"WITH {FIXES}, {_steps()}, t AS (SELECT greatest(quantile_cont(speed_mps, {p}), {least}) AS t FROM steps WHERE speed_mps > 0) SELECT order_col, coalesce(speed_mps > t, false) AS is_speed_outlier FROM steps, t"


def clean_speed_mad(k: float, least: float) -> str:
    return f"""WITH {FIXES}, {_steps()}, q AS (SELECT quantile_cont(speed_mps, 0.75) AS q FROM steps WHERE speed_mps > 0),
u AS (SELECT speed_mps AS v, ln(1+speed_mps) AS x FROM steps, q WHERE speed_mps > 0 AND speed_mps >= q),
c AS (SELECT quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.75)-quantile_cont(x, 0.25) AS iqr, quantile_cont(v, 0.995) AS top FROM u),
d AS (SELECT 1.4826*quantile_cont(abs(x-c), 0.5) AS s FROM u, c),
e AS (SELECT c, top, CASE WHEN s > 0 THEN s ELSE iqr/1.349 END AS s FROM c, d),
t AS (SELECT greatest(CASE WHEN s > 0 THEN exp(c+{k}*s)-1 ELSE top END, {least}) AS t FROM e)
SELECT order_col, coalesce(speed_mps > t, false) AS is_speed_outlier FROM steps, t"""


def _pipeline(limit: float) -> str:
    good = f"good AS (SELECT * EXCLUDE (k) FROM unique_rows WHERE NOT {_BAD_SENSOR} AND datetime IS NOT NULL AND NOT {_COORD} AND NOT {_ZERO})"
    return f"{DIRTY}, {_UNIQUE}, {good}, {_steps('good')}, slow AS (SELECT * FROM steps WHERE NOT coalesce(speed_mps > {limit}, false))"


def clean_pipeline(limit: float) -> str:
    return f"WITH {_pipeline(limit)} SELECT * FROM slow"


def clean_audit(limit: float) -> str:
    row = lambda k, step, a, b, t: f"SELECT {k} AS step_no, '{step}' AS step, 'drop' AS action, (SELECT count(*) FROM {a}) AS before_n, (SELECT count(*) FROM {b}) AS after_n, (SELECT count(*) FROM {a}) - (SELECT count(*) FROM {b}) AS n_removed, 0 AS n_flagged, CAST({t} AS DOUBLE) AS threshold_mps"
    return f"WITH {_pipeline(limit)} " + " UNION ALL ".join([row(1, "duplicates", "fixes", "unique_rows", "NULL"), row(2, "errors", "unique_rows", "good", "NULL"), row(3, "speed_fixed", "good", "slow", limit)])


def _mercator(lon: float, lat: float) -> tuple[float, float]:
    return 6378137.0 * math.radians(lon), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


_XY = "6378137.0e0*radians(lon) AS x, 6378137.0e0*ln(tan(pi()/4+radians(lat)/2)) AS y"


def _edges(ring: list) -> list:
    return list(zip(ring, [*ring[1:], ring[0]], strict=True))


def _inside(x: str, y: str, ring: list) -> str:
    """Even-odd rule by a count of crossings to the right."""
    terms = [f"(CASE WHEN ({b1!r}e0 > {y}) <> ({b2!r}e0 > {y}) AND {x} < {a1!r}e0 + ({y} - {b1!r}e0)*({(a2 - a1) / (b2 - b1)!r}e0) THEN 1 ELSE 0 END)" for (a1, b1), (a2, b2) in _edges(ring) if b1 != b2]
    return f"(({' + '.join(terms)}) % 2 = 1)".replace("e-", "E-")


def _on_edge(x: str, y: str, ring: list) -> str:
    """On an edge, to 1e-15 of the cross product, as ``geo.ring_tests`` states it."""
    between = lambda v, a, b: f"{v} BETWEEN {_number(min(a, b))} AND {_number(max(a, b))}"
    terms = [f"(abs(({x}-{_number(a1)})*{_number(b2 - b1)}-({y}-{_number(b1)})*{_number(a2 - a1)}) <= CAST(1e-15 AS DOUBLE) AND {between(x, a1, a2)} AND {between(y, b1, b2)})" for (a1, b1), (a2, b2) in _edges(ring)]
    return f"({' OR '.join(terms)})"


def _number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _path(x: str, y: str, pts: list) -> str:
    if len(pts) == 1:
        return f"sqrt(pow({x}-{_number(pts[0][0])},2)+pow({y}-{_number(pts[0][1])},2))"
    out = []
    for (a1, b1), (a2, b2) in zip(pts, pts[1:], strict=False):
        dx, dy = a2 - a1, b2 - b1
        t = f"least(greatest((({x}-{_number(a1)})*{_number(dx)}+({y}-{_number(b1)})*{_number(dy)})/{_number(dx * dx + dy * dy)}, 0), 1)"
        out.append(f"sqrt(pow({x}-({_number(a1)}+{t}*{_number(dx)}),2)+pow({y}-({_number(b1)}+{t}*{_number(dy)}),2))")
    return out[0] if len(out) == 1 else f"least({', '.join(out)})"


def append_paddock(share: float) -> str:
    cases = " ".join(f"WHEN {_inside('lon', 'lat', ring)} OR {_on_edge('lon', 'lat', ring)} THEN '{name}'" for name, ring in PADDOCKS)
    return f"""WITH {FIXES}, placed AS (SELECT *, strftime(datetime, '%Y-%m-%d') AS e, CASE {cases} END AS p FROM fixes),
n AS (SELECT {ANIMAL}, e, p, count(*) AS n FROM placed GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY {ANIMAL}, e) AS total FROM n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ANIMAL}, e ORDER BY n DESC, p) AS k FROM r WHERE p IS NOT NULL) x WHERE k = 1 AND n/total >= {share})
SELECT placed.order_col, best.p AS assigned_paddock FROM placed LEFT JOIN best USING (deployment_id, animal_id, sensor_id, e)"""


def clean_spatial(buffer_m: float) -> str:
    rings = [(name, [_mercator(*p) for p in ring]) for name, ring in PADDOCKS]
    cases = " ".join(f"WHEN {_inside('x', 'y', ring)} OR {_path('x', 'y', [*ring, ring[0]])} <= {buffer_m} THEN '{name}'" for name, ring in rings)
    return f"WITH {FIXES}, p AS (SELECT *, {_XY} FROM fixes) SELECT *, paddock IS NULL AS is_outside_boundary FROM (SELECT *, CASE {cases} END AS paddock FROM p) q"


def _distances() -> str:
    parts = []
    for k, r in enumerate(RESOURCES):
        pts = [_mercator(*p) for p in r.vertices]
        d = f"CASE WHEN {_inside('x', 'y', pts)} THEN 0 ELSE {_path('x', 'y', [*pts, pts[0]])} END" if r.polygon else _path("x", "y", pts)
        parts.append(f"SELECT *, {k} AS k, '{r.resource_id}' AS resource_id, '{r.resource_type}' AS resource_type, {d} AS d FROM p")
    return f"p AS (SELECT *, {_XY} FROM fixes), away AS ({' UNION ALL '.join(parts)})"


_NEAREST = "nearest AS (SELECT *, resource_id AS nearest_resource_id, resource_type AS nearest_resource_type, d AS resource_distance_m, 'EPSG:3857' AS metric_crs FROM (SELECT *, row_number() OVER (PARTITION BY order_col ORDER BY d, k) AS best FROM away) b WHERE best = 1)"


def resource_distance() -> str:
    return f"WITH {FIXES}, {_distances()}, {_NEAREST} SELECT * FROM nearest"


def _use(radius: float) -> str:
    return f"""{_distances()}, dated AS (SELECT *, {_epoch('day')} FROM away),
used AS (SELECT {ANIMAL}, {EPOCH}, resource_id, count(*) AS n_total_fixes, count(*) AS n_fixes, count(*) FILTER (WHERE d <= {radius}) AS n_fixes_near, (count(*) FILTER (WHERE d <= {radius}))/CAST(count(*) AS DOUBLE) AS prop_fixes_near, avg(d) AS mean_distance_m, quantile_cont(d, 0.5) AS median_distance_m, min(d) AS min_distance_m
  FROM dated GROUP BY {ANIMAL}, {EPOCH}, resource_id)"""


def resource_use(radius: float) -> str:
    return f"WITH {FIXES}, {_use(radius)} SELECT * FROM used"


def resource_epoch(radius: float, source: str = FIXES) -> str:
    return f"""WITH {source}, {_use(radius)} SELECT {ANIMAL}, {EPOCH}, count(DISTINCT resource_id) AS n_resources, sum(n_fixes) AS n_resource_fix_rows, sum(n_fixes_near) AS n_fixes_near_resource, sum(n_fixes_near)/max(n_total_fixes) AS prop_fixes_near_resource,
  sum(mean_distance_m*n_fixes)/sum(n_fixes) AS mean_resource_distance_m, min(min_distance_m) AS min_resource_distance_m FROM used GROUP BY {ANIMAL}, {EPOCH}"""


def resource_visits(radius: float, gap: float) -> str:
    w = f"(PARTITION BY {ANIMAL} ORDER BY datetime, order_col)"
    return f"""WITH {FIXES}, {_distances()}, {_NEAREST},
b AS (SELECT *, resource_distance_m <= {radius} AS near, lag(resource_distance_m <= {radius}) OVER {w} AS was, lag(nearest_resource_id) OVER {w} AS other, (epoch_us(datetime)-epoch_us(lag(datetime) OVER {w}))/60e6 AS gap FROM nearest),
c AS (SELECT *, sum(CASE WHEN near AND NOT coalesce(was AND other = nearest_resource_id AND gap <= {gap}, false) THEN 1 ELSE 0 END) OVER {w} AS v FROM b),
d2 AS (SELECT {ANIMAL}, v, nearest_resource_id AS resource_id, min(datetime) AS visit_start, max(datetime) AS visit_end, count(*) AS n_fixes, min(resource_distance_m) AS min_distance_m, avg(resource_distance_m) AS mean_distance_m FROM c WHERE near GROUP BY {ANIMAL}, v, nearest_resource_id)
SELECT *, (epoch_us(visit_end)-epoch_us(visit_start))/60e6 AS duration_mins, row_number() OVER (ORDER BY {ANIMAL}, v) AS visit_id FROM d2"""


def _grid(step_us: int, groups: str) -> str:
    return f"""timed AS (SELECT *, epoch_us(datetime) AS t FROM fixes),
spans AS (SELECT {groups}, CAST(floor(min(t)/{step_us}.0e0) AS BIGINT)*{step_us} AS lo, CAST(ceil(max(t)/{step_us}.0e0) AS BIGINT)*{step_us} AS hi FROM timed GROUP BY {groups}),
grid AS (SELECT {groups}, unnest(generate_series(lo, hi, {step_us})) AS g FROM spans)"""


def regularise(mins: float) -> str:
    us = int(mins * 60e6)
    return f"""WITH {FIXES}, {_grid(us, ANIMAL)}, near AS (SELECT *, CAST(round_even(t/{us}.0e0, 0) AS BIGINT)*{us} AS g FROM timed),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ANIMAL}, g ORDER BY abs(t-g), order_col) AS k FROM near WHERE abs(t-g) <= {us / 2}) x WHERE k = 1),
same AS (SELECT {ANIMAL}, min(treatment) AS treatment FROM fixes GROUP BY {ANIMAL} HAVING min(treatment) = max(treatment))
SELECT grid.*, make_timestamp(grid.g) AS datetime, b.lon, b.lat, s.treatment, b.datetime AS observed_datetime, (b.t-b.g)/1e6 AS time_offset_s, b.t IS NOT NULL AS is_observed
FROM grid LEFT JOIN best b USING ({ANIMAL}, g) LEFT JOIN same s USING ({ANIMAL})"""


def _interpolated(us: int) -> str:
    w = f"PARTITION BY {ANIMAL} ORDER BY t"
    return f"""{_grid(us, ANIMAL)},
anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ANIMAL}, t ORDER BY order_col) AS k FROM timed WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) x WHERE k = 1),
both_ AS (SELECT {ANIMAL}, coalesce(g, t) AS t, g IS NOT NULL AS is_grid, a.t IS NOT NULL AS is_observed, a.lon, a.lat FROM (SELECT {ANIMAL}, g, g AS t FROM grid) gr FULL JOIN (SELECT {ANIMAL}, t, lon, lat FROM anchors) a USING ({ANIMAL}, t)),
sides AS (SELECT *, last_value(CASE WHEN is_observed THEN t END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt, last_value(lon IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plon, last_value(lat IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plat,
  first_value(CASE WHEN is_observed THEN t END IGNORE NULLS) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt, first_value(lon IGNORE NULLS) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nlon, first_value(lat IGNORE NULLS) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nlat FROM both_),
filled AS (SELECT {ANIMAL}, make_timestamp(t) AS datetime, is_observed, NOT is_observed AND pt IS NOT NULL AND nt IS NOT NULL AS is_interpolated,
  CASE WHEN is_observed THEN lon ELSE plon+(t-pt)/CAST(nt-pt AS DOUBLE)*(nlon-plon) END AS lon, CASE WHEN is_observed THEN lat ELSE plat+(t-pt)/CAST(nt-pt AS DOUBLE)*(nlat-plat) END AS lat,
  CASE WHEN NOT is_observed THEN (nt-pt)/1e6 END AS interpolation_gap_s FROM sides WHERE is_grid)"""


def interpolate(mins: float, source: str = FIXES) -> str:
    return f"WITH {source}, {_interpolated(int(mins * 60e6))}, same AS (SELECT {ANIMAL}, min(treatment) AS treatment FROM fixes GROUP BY {ANIMAL} HAVING min(treatment) = max(treatment)) SELECT f.*, s.treatment FROM filled f LEFT JOIN same s USING ({ANIMAL})"


def grid_diagnostics(mins: float) -> str:
    return f"""WITH {FIXES}, {_interpolated(int(mins * 60e6))}, gaps AS (SELECT {ANIMAL}, (t-lag(t) OVER (PARTITION BY {ANIMAL} ORDER BY t))/60e6 AS gap FROM timed),
a AS (SELECT {ANIMAL}, count(*) AS n_fixes, quantile_cont(gap, 0.5) AS median_gap_mins, max(gap) AS max_gap_mins FROM gaps GROUP BY {ANIMAL}),
b AS (SELECT {ANIMAL}, count(*) AS n_grid, count(*) FILTER (WHERE is_observed) AS n_observed, count(*) FILTER (WHERE is_interpolated) AS n_interpolated FROM filled GROUP BY {ANIMAL})
SELECT * FROM a JOIN b USING ({ANIMAL})"""


def _gap_summary(source: str, name: str) -> str:
    return f"{name} AS (SELECT {ANIMAL}, count(gap) AS n_observed_gaps, min(gap) AS gap_min_s, quantile_cont(gap, 0.5) AS gap_median_s, max(gap) AS gap_max_s FROM (SELECT {ANIMAL}, (epoch_us(datetime)-lag(epoch_us(datetime)) OVER (PARTITION BY {ANIMAL} ORDER BY datetime))/1e6 AS gap FROM (SELECT DISTINCT {ANIMAL}, datetime FROM {source}) d) g GROUP BY {ANIMAL})"


_SEEN = f"seen AS (SELECT {ANIMAL}, count(*) AS n_observed_fixes, count(DISTINCT datetime) AS n_observed_timestamps, count(*)-count(DISTINCT datetime) AS n_duplicate_timestamps FROM fixes GROUP BY {ANIMAL})"


def regularise_diagnostics(mins: float) -> str:
    return f"""WITH made AS (SELECT * FROM ({regularise(mins)}) r), {FIXES}, {_SEEN}, {_gap_summary('fixes', 'gaps')}, {_gap_summary('made', 'reached')},
m AS (SELECT {ANIMAL}, count(*) AS n_expected_fixes, count(*) FILTER (WHERE is_observed) AS n_observed_on_grid, quantile_cont(abs(time_offset_s), 0.5) AS median_abs_time_offset_s, max(abs(time_offset_s)) AS max_abs_time_offset_s FROM made GROUP BY {ANIMAL})
SELECT *, 0 AS n_interpolated, 0 AS prop_interpolated, 0 AS n_missing_datetime, greatest(n_observed_fixes-n_observed_on_grid, 0) AS n_unmatched_observed_fixes, {mins / 2} AS tolerance_mins, {mins * 60} AS sampling_interval_target_s, {mins} AS interval_mins
FROM seen JOIN m USING ({ANIMAL}) JOIN gaps USING ({ANIMAL}) JOIN (SELECT {ANIMAL}, gap_median_s AS sampling_interval_achieved_s FROM reached) q USING ({ANIMAL})"""


def interpolate_diagnostics(mins: float) -> str:
    return f"""WITH made AS (SELECT * FROM ({interpolate(mins)}) r), {FIXES}, {_SEEN}, {_gap_summary('fixes', 'gaps')}, {_gap_summary('made', 'reached')},
m AS (SELECT {ANIMAL}, count(*) AS n_expected_fixes, count(*) FILTER (WHERE is_observed) AS n_observed_on_grid, count(*) FILTER (WHERE is_interpolated) AS n_interpolated, count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) AS n_unfilled_grid_fixes FROM made GROUP BY {ANIMAL})
SELECT *, n_observed_timestamps AS n_valid_anchor_timestamps, n_interpolated/n_expected_fixes AS prop_interpolated, 0 AS n_invalid_coordinate_fixes, 0 AS n_missing_datetime, {mins * 60} AS sampling_interval_target_s, {mins} AS interval_mins
FROM seen JOIN m USING ({ANIMAL}) JOIN gaps USING ({ANIMAL}) JOIN (SELECT {ANIMAL}, gap_median_s AS sampling_interval_achieved_s FROM reached) q USING ({ANIMAL})"""


def downsample_diagnostics(mins: float, phase: float, method: str) -> str:
    us, ph = int(mins * 60e6), int(phase * 60e6)
    return f"""WITH made AS (SELECT * FROM ({downsample(mins, phase, method)}) r), {FIXES}, {_SEEN}, {_gap_summary('made', 'gaps')},
e AS (SELECT {ANIMAL}, greatest(CASE WHEN min(epoch_us(datetime))+{ph} <= max(epoch_us(datetime)) THEN floor((max(epoch_us(datetime))-min(epoch_us(datetime))-{ph})/{us}.0e0)+1 ELSE 0 END, 0) AS n_expected_fixes FROM fixes GROUP BY {ANIMAL}),
m AS (SELECT {ANIMAL}, count(*) AS rows_ FROM made GROUP BY {ANIMAL})
SELECT s.*, n_expected_fixes, coalesce(rows_, 0) AS n_retained_fixes, 0 AS n_interpolated, CASE WHEN n_expected_fixes > 0 THEN 0 END AS prop_interpolated, 0 AS n_missing_datetime, coalesce(n_observed_gaps, 0) AS n_observed_gaps, gap_min_s, gap_median_s, gap_max_s, {mins * 60} AS sampling_interval_target_s, gap_median_s AS sampling_interval_achieved_s, {mins} AS interval_mins, {phase} AS phase_mins
FROM seen s JOIN e USING ({ANIMAL}) LEFT JOIN m USING ({ANIMAL}) LEFT JOIN gaps USING ({ANIMAL})"""


def downsample(mins: float, phase: float, method: str) -> str:
    us, ph = int(mins * 60e6), int(phase * 60e6)
    k = f"floor((t-t0)/{us}.0e0)" if method == "rigid" else f"floor((t-t0)/{us}.0e0+0.5)"
    order = "t, order_col" if method == "rigid" else f"abs(t-(t0+k*{us})), t, order_col"
    return f"""WITH {FIXES}, a AS (SELECT *, epoch_us(datetime) AS t, min(epoch_us(datetime)) OVER (PARTITION BY {ANIMAL})+{ph} AS t0, max(epoch_us(datetime)) OVER (PARTITION BY {ANIMAL}) AS t1 FROM fixes),
b AS (SELECT *, {k} AS k, floor((t1-t0)/{us}.0e0)+1 AS n FROM a WHERE t0 <= t1)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ANIMAL}, k ORDER BY {order}) AS r FROM b WHERE k >= 0 AND k < n) x WHERE r = 1"""


_LESS = "(a.animal_id, a.sensor_id, a.order_col) < (b.animal_id, b.sensor_id, b.order_col)"
_PAIRS = f"pairs AS (SELECT a.order_col AS row_a, b.order_col AS row_b, a.deployment_id, a.datetime, a.sensor_id || ':' || b.sensor_id AS pair_id, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS distance_m FROM fixes a JOIN fixes b ON a.deployment_id = b.deployment_id AND a.datetime = b.datetime AND {_LESS})"


def proximity() -> str:
    return f"WITH {HOURLY}, {_PAIRS} SELECT * FROM pairs"


def _social() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE d <= {t}) AS n_neighbours_within_{t}m" for t in (250, 1000))
    return f"""others AS (SELECT a.order_col, b.animal_id AS other, b.sensor_id AS other_sensor, b.order_col AS other_row, NOT ({_LESS}) AS earlier, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM fixes a JOIN fixes b ON a.deployment_id = b.deployment_id AND a.datetime = b.datetime AND a.order_col <> b.order_col),
agg AS (SELECT order_col, avg(d) AS mean_distance_to_others_m, {counts} FROM others GROUP BY order_col),
best AS (SELECT order_col, other AS nearest_animal_id, d AS nearest_neighbour_m FROM (SELECT *, row_number() OVER (PARTITION BY order_col ORDER BY d, earlier, other, other_sensor, other_row) AS k FROM others) x WHERE k = 1),
rows_ AS (SELECT f.*, count(*) OVER (PARTITION BY deployment_id, datetime) AS social_group_size, count(*) OVER (PARTITION BY deployment_id, datetime) AS n_valid_fixes, nearest_animal_id, nearest_neighbour_m, mean_distance_to_others_m,
  {', '.join(f'coalesce(n_neighbours_within_{t}m, 0) AS n_neighbours_within_{t}m, coalesce(n_neighbours_within_{t}m, 0) > 0 AS any_neighbour_within_{t}m' for t in (250, 1000))}
  FROM fixes f LEFT JOIN agg USING (order_col) LEFT JOIN best USING (order_col))"""


def social_rows() -> str:
    return f"WITH {HOURLY}, {_social()} SELECT * FROM rows_"


def contacts(limit: float, gap: float | str) -> str:
    w = "(PARTITION BY deployment_id, pair_id ORDER BY datetime, row_a, row_b)"  # a pair can meet more than once at a time
    return f"""WITH {HOURLY}, {_PAIRS}, near AS (SELECT *, (epoch_us(datetime)-epoch_us(lag(datetime) OVER {w}))/60e6 AS gap FROM pairs WHERE distance_m <= {limit}),
runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY deployment_id, pair_id ORDER BY datetime, row_a, row_b ROWS UNBOUNDED PRECEDING) AS contact_event_id FROM near)
SELECT deployment_id, pair_id, contact_event_id, min(datetime) AS contact_start, max(datetime) AS contact_end, (epoch_us(max(datetime))-epoch_us(min(datetime)))/1e6 AS duration_s, count(*) AS n_contact_fixes, min(distance_m) AS min_distance_m, avg(distance_m) AS mean_distance_m, max(distance_m) AS max_distance_m
FROM runs GROUP BY deployment_id, pair_id, contact_event_id"""


def _social_day() -> str:
    more = ", ".join(f"avg(n_neighbours_within_{t}m) AS mean_n_neighbours_within_{t}m, avg(CASE WHEN any_neighbour_within_{t}m THEN 1.0 ELSE 0.0 END) AS prop_any_neighbour_within_{t}m" for t in (250, 1000))
    return f"""{_social()}, social_dated AS (SELECT *, {_epoch('day')} FROM rows_),
social_days AS (SELECT {ANIMAL}, {EPOCH}, count(*) AS n_fixes, count(nearest_neighbour_m) AS n_social_fixes, avg(social_group_size) AS mean_social_group_size, avg(n_valid_fixes) AS mean_valid_fixes, avg(nearest_neighbour_m) AS mean_nearest_neighbour_m,
  quantile_cont(nearest_neighbour_m, 0.5) AS median_nearest_neighbour_m, quantile_cont(nearest_neighbour_m, 0.95) AS p95_nearest_neighbour_m, avg(mean_distance_to_others_m) AS mean_distance_to_others_m, {more} FROM social_dated GROUP BY {ANIMAL}, {EPOCH})"""


def social_day() -> str:
    return f"WITH {HOURLY}, {_social_day()} SELECT * FROM social_days"


def epoch_merge() -> str:
    return f"WITH {HOURLY}, {_social_day()}, {_movement('day', None, ANIMAL.split(', '))} SELECT m.*, s.* EXCLUDE ({ANIMAL}, {EPOCH}, n_fixes), s.n_fixes AS social_n_fixes FROM moved m FULL JOIN social_days s USING ({ANIMAL}, {EPOCH})"


def epoch_all(radius: float) -> str:
    """All four blocks by day, each stated as its own query."""
    by = f"{ANIMAL}, {EPOCH}"
    spatial = f"""WITH {HOURLY}, p AS (SELECT *, {_XY} FROM fixes), {_hulls('day')},
basic AS (SELECT {by}, count(*) AS spatial_n_fixes, min(lon) AS lon_min, max(lat) AS lat_max FROM dated GROUP BY {by})
SELECT basic.*, h.area_ha AS mcp100_area_ha FROM basic JOIN hulls h USING ({by}) WHERE h.percent = 100"""
    return f"SELECT * FROM ({epoch_merge()}) m FULL JOIN ({spatial}) s USING ({by}) FULL JOIN ({resource_epoch(radius, HOURLY)}) r USING ({by})"


_BOXES = "boxes AS (SELECT sensor_id AS name, CAST(substr(sensor_id, 2) AS BIGINT) AS no, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM fixes GROUP BY sensor_id)"


def layer_paddock(share: float) -> str:
    return f"""WITH {FIXES}, {_BOXES}, hit AS (SELECT f.order_col, arg_min(b.name, b.no) AS p FROM fixes f JOIN boxes b ON f.lon BETWEEN x0 AND x1 AND f.lat BETWEEN y0 AND y1 GROUP BY f.order_col),
placed AS (SELECT f.*, strftime(datetime, '%Y-%m-%d') AS e, p FROM fixes f LEFT JOIN hit USING (order_col)),
n AS (SELECT {ANIMAL}, e, p, count(*) AS n FROM placed GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY {ANIMAL}, e) AS total FROM n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ANIMAL}, e ORDER BY n DESC, p) AS k FROM r WHERE p IS NOT NULL) x WHERE k = 1 AND n/total >= {share})
SELECT placed.order_col, best.p AS assigned_paddock FROM placed LEFT JOIN best USING (deployment_id, animal_id, sensor_id, e)"""


def layer_nearest() -> str:
    return f"""WITH {FIXES}, {_BOXES}, p AS (SELECT *, {_XY} FROM fixes), c AS (SELECT name, no, x0 AS lon, y0 AS lat, {_XY.replace('(lon)', '(x0)').replace('(lat)', '(y0)')} FROM boxes)
SELECT p.order_col, arg_min(c.name, (sqrt(pow(p.x-c.x, 2)+pow(p.y-c.y, 2)), c.no)) AS nearest_resource_id, min(sqrt(pow(p.x-c.x, 2)+pow(p.y-c.y, 2))) AS resource_distance_m,
  arg_min(CASE WHEN c.no % 2 = 0 THEN 'water' ELSE 'shade' END, (sqrt(pow(p.x-c.x, 2)+pow(p.y-c.y, 2)), c.no)) AS nearest_resource_type FROM p, c GROUP BY p.order_col"""


def map_polygons() -> str:
    return f"WITH {FIXES}, {_BOXES} SELECT 'Paddocks' AS map_group, no AS layer_no, name AS label, 5 AS n_points, x1-x0 AS width, y1-y0 AS height FROM boxes"


def group_summary() -> str:
    return f"""WITH {FIXES}, {_movement('week', None, [*ANIMAL.split(', '), 'treatment'])} SELECT deployment_id, treatment, {EPOCH}, count(*) AS n_animal_epochs, count(DISTINCT animal_id) AS n_animals, count(DISTINCT sensor_id) AS n_sensors, sum(n_fixes) AS n_fixes,
  sum(total_distance_m) AS total_distance_m, avg(total_distance_m) AS mean_total_distance_m, avg(mean_speed_mps) AS mean_speed_mps FROM moved GROUP BY deployment_id, treatment, {EPOCH}"""


def diurnal() -> str:
    return f"WITH {FIXES}, {_movement('hour', None, ANIMAL.split(', '))} SELECT *, strftime(epoch_start, '%Y-%m-%d') AS date, hour(epoch_start) AS hour FROM moved"


def hotspots(size: float, q: float) -> str:
    return f"""WITH {FIXES}, p AS (SELECT *, {_XY}, {_epoch('week')} FROM fixes), c AS (SELECT {ANIMAL}, {EPOCH}, floor(x/{size}) AS cell_x, floor(y/{size}) AS cell_y, count(*) AS n_fixes FROM p GROUP BY ALL),
t AS (SELECT {ANIMAL}, {EPOCH}, sum(n_fixes) AS total_fixes, quantile_cont(n_fixes, {q}) AS hotspot_count_threshold FROM c GROUP BY {ANIMAL}, {EPOCH})
SELECT c.*, total_fixes, hotspot_count_threshold, n_fixes/total_fixes AS prop_fixes, degrees((cell_x+0.5)*{size}/6378137.0e0) AS cell_centre_lon, degrees(2*atan(exp((cell_y+0.5)*{size}/6378137.0e0))-pi()/2) AS cell_centre_lat
FROM c JOIN t USING ({ANIMAL}, {EPOCH}) WHERE n_fixes >= hotspot_count_threshold"""


def _utm(zone: str, north: str) -> str:
    """Easting and northing by Krueger's series, from the axis and flattening of WGS84."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    east = "+".join(["eta", *[f"{c!r}*cos({2 * k}*xi)*cast(sinh({2 * k}*eta) as double)" for k, c in enumerate(alpha, 1)]])
    up = "+".join(["xi", *[f"{c!r}*sin({2 * k}*xi)*cast(cosh({2 * k}*eta) as double)" for k, c in enumerate(alpha, 1)]])
    return f"""u1 AS (SELECT fixes.*, {zone} AS zone, {north} AS north, sinh(atanh(sin(radians(lat)))-{e!r}*atanh({e!r}*sin(radians(lat)))) AS t, radians(lon-({zone}*6-183)) AS lam FROM fixes, z),
u2 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM u1),
p AS (SELECT *, 500000+{a!r}*({east}) AS x, CASE WHEN north THEN 0 ELSE 10000000 END+{a!r}*({up}) AS y FROM u2)"""


def _hulls(level: str) -> str:
    """Hull areas by the edge test: an edge has every point on its left or on it, and none between its ends."""
    by = f"{ANIMAL}, {EPOCH}"
    return f"""dated AS (SELECT *, {_epoch(level)} FROM p),
middle AS (SELECT *, count(*) OVER w AS n_fixes, sqrt(pow(x-avg(x) OVER w, 2)+pow(y-avg(y) OVER w, 2)) AS d, min(x) OVER w AS x0, min(y) OVER w AS y0 FROM dated WINDOW w AS (PARTITION BY {by})),
wanted AS (SELECT {by}, 100.0e0 AS percent, max(d) AS cut FROM middle GROUP BY {by} UNION ALL SELECT {by}, 95.0e0, quantile_cont(d, 0.95) FROM middle GROUP BY {by}),
corner AS (SELECT DISTINCT {by}, percent, n_fixes, x-x0 AS x, y-y0 AS y FROM middle JOIN wanted USING ({by}) WHERE percent >= 100 OR d <= cut),
edge AS (SELECT {by}, a.percent, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, min((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) AS left_of,
  count(*) FILTER (WHERE (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) = 0 AND (c.x-a.x)*(c.x-b.x)+(c.y-a.y)*(c.y-b.y) < 0) AS between_
  FROM corner a JOIN corner b USING ({by}, percent) JOIN corner c USING ({by}, percent) WHERE a.x <> b.x OR a.y <> b.y GROUP BY {by}, a.percent, a.x, a.y, b.x, b.y),
enclosed AS (SELECT {by}, percent, sum(ax*b_y-ay*bx)/2/1e4 AS area_ha FROM edge WHERE left_of >= 0 AND between_ = 0 GROUP BY {by}, percent),
hulls AS (SELECT c.*, CASE WHEN n_fixes >= 5 AND n_fixes_used >= 3 AND area_ha > 0 THEN area_ha END AS area_ha FROM (SELECT {by}, percent, n_fixes, count(*) AS n_fixes_used FROM corner GROUP BY ALL) c LEFT JOIN enclosed USING ({by}, percent))"""


def mcp_area() -> str:
    return f"WITH {FIXES}, p AS (SELECT *, {_XY} FROM fixes), {_hulls('month')} SELECT * FROM hulls"


def spatial_week() -> str:
    by = f"{ANIMAL}, {EPOCH}"
    return f"""WITH {FIXES}, z AS (SELECT CAST(floor((avg(lon)+180)/6) AS INTEGER)+1 AS zone_, avg(lat) >= 0 AS north_ FROM fixes), {_utm('zone_', 'north_')}, {_hulls('week')},
basic AS (SELECT {by}, count(*) AS n_fixes, (epoch_us(max(datetime))-epoch_us(min(datetime)))/3.6e9 AS span_hours, min(lon) AS lon_min, max(lat) AS lat_max, avg(lon) AS centroid_lon, avg(lat) AS centroid_lat, any_value('EPSG:' || (CASE WHEN north THEN 32600 ELSE 32700 END+zone)) AS metric_crs FROM dated GROUP BY {by})
SELECT basic.*, h.area_ha AS mcp100_area_ha, k.area_ha AS mcp95_area_ha FROM basic JOIN hulls h USING ({by}) JOIN hulls k USING ({by}) WHERE h.percent = 100 AND k.percent = 95"""


def kde_cells(max_cells: int = 10000) -> str:
    by = f"{ANIMAL}, {EPOCH}"
    low = lambda v: f"coalesce(nullif(least(sd_{v}, (quantile_cont({v}, 0.75)-quantile_cont({v}, 0.25))/1.34), 0), nullif(sd_{v}, 0), nullif(abs(first_{v}), 0), 1)"
    band = lambda v: f"greatest(0.9*{low(v)}*pow(count(*), -0.2), 1)"
    count = lambda v, c: f"CAST(floor((hi_{v}-lo_{v}+6*w{v})/{c}+1e-9) AS BIGINT)+1"
    bell = lambda v: f"exp(-0.5*pow((g{v}-{v})/w{v}, 2))/(w{v}*sqrt(2*pi()))"
    return f"""WITH {FIXES}, p AS (SELECT *, {_XY}, {_epoch('month')} FROM fixes),
spread AS (SELECT *, stddev_samp(x) OVER w AS sd_x, stddev_samp(y) OVER w AS sd_y, first_value(x) OVER (PARTITION BY {by} ORDER BY order_col) AS first_x, first_value(y) OVER (PARTITION BY {by} ORDER BY order_col) AS first_y FROM p WINDOW w AS (PARTITION BY {by})),
bands AS (SELECT {by}, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, {band('x')} AS wx, {band('y')} AS wy FROM spread GROUP BY {by}, sd_x, sd_y, first_x, first_y HAVING count(*) >= 5),
c1 AS (SELECT *, greatest(1.0, least(wx, wy)/2) AS c FROM bands),
c2 AS (SELECT *, ({count('x', 'c')}) * ({count('y', 'c')}) AS much FROM c1),
c3 AS (SELECT * EXCLUDE (c), CASE WHEN much > {max_cells} THEN c*sqrt(much/{max_cells}.0e0) ELSE c END AS c FROM c2),
gx AS (SELECT {by}, order_col, ix, gx, {bell('x')} AS ex FROM (SELECT *, ix*c+lo_x-3*wx AS gx FROM (SELECT *, unnest(generate_series(0, {count('x', 'c')}-1)) AS ix FROM c3) q) g JOIN p USING ({by})),
gy AS (SELECT {by}, order_col, iy, gy, {bell('y')} AS ey FROM (SELECT *, iy*c+lo_y-3*wy AS gy FROM (SELECT *, unnest(generate_series(0, {count('y', 'c')}-1)) AS iy FROM c3) q) g JOIN p USING ({by})),
z AS (SELECT {by}, gx, gy, sum(ex*ey)/count(*) AS kde_density FROM gx JOIN gy USING ({by}, order_col) GROUP BY {by}, ix, iy, gx, gy),
shares AS (SELECT *, kde_density/sum(kde_density) OVER (PARTITION BY {by}) AS cell_probability, row_number() OVER (PARTITION BY {by} ORDER BY kde_density DESC, gx, gy) AS density_rank FROM z),
summed AS (SELECT *, sum(cell_probability) OVER (PARTITION BY {by} ORDER BY density_rank ROWS UNBOUNDED PRECEDING) AS cumulative_probability FROM shares)
SELECT *, cumulative_probability-cell_probability < 0.5 AS in_kde50 FROM summed WHERE cumulative_probability-cell_probability < 0.95"""


def activity_features() -> str:
    return f"WITH {FIXES}, {_steps()} SELECT order_col, ln(1+step_m) AS _f_step, abs(turn_rad) AS _f_turn FROM steps"


def _adaptive() -> str:
    """Features over a trailing window; the first fix of a window by a plain search among the fixes of its track."""
    w = f"(PARTITION BY {TRACK} ORDER BY datetime, order_col)"
    return f"""{_steps()}, runs AS (
  SELECT *, epoch_us(datetime) AS t, sum(coalesce(step_m, 0)) OVER (PARTITION BY {TRACK} ORDER BY datetime, order_col ROWS UNBOUNDED PRECEDING) AS run, epoch_us(datetime)-lag(epoch_us(datetime)) OVER {w} AS gap FROM steps
), widths AS (
  SELECT {TRACK}, greatest(1800000000, coalesce(CAST(4*quantile_cont(gap, 0.5) FILTER (WHERE gap > 0) AS BIGINT), 0)) AS width FROM runs GROUP BY {TRACK}
), firsts AS (
  SELECT a.order_col, arg_min(struct_pack(lon := b.lon, lat := b.lat, run := b.run), (b.t, b.order_col)) AS f FROM runs a JOIN widths USING ({TRACK}) JOIN runs b USING ({TRACK}) WHERE b.t > a.t-width AND b.t <= a.t GROUP BY a.order_col
), nets AS (
  SELECT r.*, {_hav('f.lon', 'f.lat', 'lon', 'lat')} AS net, greatest(r.run-f.run, 0) AS path FROM runs r JOIN firsts USING (order_col)
), features AS (
  SELECT *, ln(1+step_m) AS f0, abs(turn_rad) AS f1, ln(1+net) AS f2, CASE WHEN path > 0 THEN least(net/path, 1) ELSE 0 END AS f3 FROM nets
)"""


def adaptive_features() -> str:
    return f"WITH {FIXES}, {_adaptive()} SELECT order_col, f0 AS _f_step, f1 AS _f_turn, f2 AS _f_net, f3 AS _f_straight FROM features"


def _mixture(d: int, rounds: int = 200, tol: str = "1e-5") -> str:
    """Expectation maximisation as a recursion over one row of state, from the halves at the median of the first feature."""
    cell = [(k, j) for k in (0, 1) for j in range(d)]
    state = [f"w{k}" for k in (0, 1)] + [f"{a}{k}{j}" for a in "mv" for k, j in cell]
    side = ("f0 <= m", "f0 > m")
    begin = ["0.5e0"] * 2 + [f"avg(f{j}) FILTER (WHERE {side[k]})" for k, j in cell] + [f"var_pop(f{j}) FILTER (WHERE {side[k]})+1e-6" for k, j in cell]
    log = lambda k: f"ln(w{k})-0.5*ln(2*pi())*{d}" + "".join(f"-0.5*ln(v{k}{j})-0.5*(f{j}-m{k}{j})*(f{j}-m{k}{j})/v{k}{j}" for j in range(d))
    named = ", ".join(f"{x} AS {c}" for x, c in zip(begin, state, strict=True))
    held = ", ".join(f"any_value(m{k}{j}) AS m{k}{j}" for k, j in cell)
    sums = ", ".join([f"sum(r{k})+1e-12 AS n{k}" for k in (0, 1)] + [f"sum(r{k}*(f{j}-m{k}{j})) AS d{k}{j}, sum(r{k}*(f{j}-m{k}{j})*(f{j}-m{k}{j})) AS q{k}{j}" for k, j in cell])
    new = ", ".join([f"n{k}/(n0+n1)" for k in (0, 1)] + [f"m{k}{j}+d{k}{j}/n{k}" for k, j in cell] + [f"greatest(q{k}{j}/n{k}-pow(d{k}{j}/n{k}, 2), 1e-6)" for k, j in cell])
    both = "greatest(l0, l1)+ln(1+exp(-abs(l0-l1)))"
    return f"""x AS (SELECT *, {_usable(d)} AS ok FROM features),
rows_ AS (SELECT * FROM x WHERE ok),
em AS (
  SELECT 0 AS it, CAST('-Infinity' AS DOUBLE) AS ll, CAST('Infinity' AS DOUBLE) AS moved, {named} FROM rows_, (SELECT quantile_cont(f0, 0.5) AS m FROM rows_)
  UNION ALL
  SELECT it+1, ll_now, abs(ll_now-ll), {new} FROM (
    SELECT it, ll, avg(a) AS ll_now, {held}, {sums} FROM (SELECT *, exp(l0-a) AS r0, exp(l1-a) AS r1 FROM (SELECT *, {both} AS a FROM (SELECT em.*, rows_.* EXCLUDE (ok), {log(0)} AS l0, {log(1)} AS l1 FROM em, rows_ WHERE em.it < {rounds} AND em.moved >= {tol}))) GROUP BY it, ll)
), fit AS (SELECT * FROM em ORDER BY it DESC LIMIT 1),
idle AS (SELECT CASE WHEN {_moved(1, d)} < {_moved(0, d)} THEN 1 ELSE 0 END AS idle FROM fit),
scored AS (SELECT x.*, idle, CASE WHEN ok THEN 1/(1+exp(least(CASE WHEN idle = 0 THEN ({log(1)})-({log(0)}) ELSE ({log(0)})-({log(1)}) END, 700))) END AS p FROM x, fit, idle)"""


def _usable(d: int) -> str:
    return " AND ".join(f"coalesce(isfinite(f{j}), false)" for j in range(d))


def _moved(k: int, d: int) -> str:
    return f"exp(m{k}0)" + (f"+exp(m{k}2)" if d > 2 else "")


def activity_gmm() -> str:
    return f"""WITH RECURSIVE {FIXES}, {_steps()}, features AS (SELECT *, ln(1+step_m) AS f0, abs(turn_rad) AS f1 FROM steps), {_mixture(2)}
SELECT order_col, p AS inactive_prob, CASE WHEN p >= 0.5 THEN 'inactive' WHEN p < 0.5 THEN 'active' END AS activity_state, CASE WHEN p >= 0.5 THEN idle+1 WHEN p < 0.5 THEN 2-idle END AS activity_state_component FROM scored"""


def activity_gmm_hmm(stay: float = 0.98) -> str:
    """Decoding row by row: scores with their origins forwards, the path backwards, and both halves of the posterior."""
    leave = round(1 - stay, 12)
    s, t = f"ln({stay}e0)", f"ln({leave}e0)"
    w = f"(PARTITION BY {TRACK} ORDER BY datetime, order_col)"
    return f"""WITH RECURSIVE {FIXES}, {_adaptive()}, {_mixture(4)},
placed AS (SELECT *, row_number() OVER {w} AS place, least(greatest(p, 1e-12), 1-1e-12) AS p0 FROM scored),
chain AS (SELECT *, row_number() OVER (PARTITION BY {TRACK}, seq ORDER BY place) AS i, count(*) OVER (PARTITION BY {TRACK}, seq) AS n, ln(p0) AS e0, ln(1-p0) AS e1
  FROM (SELECT *, place-row_number() OVER (PARTITION BY {TRACK} ORDER BY place) AS seq FROM placed WHERE ok)),
ahead AS (
  SELECT {TRACK}, seq, i, ln(0.5e0)+e0 AS s0, ln(0.5e0)+e1 AS s1, 0 AS b0, 0 AS b1, p0 AS a0 FROM chain WHERE i = 1
  UNION ALL
  SELECT c.deployment_id, c.sensor_id, c.seq, c.i, greatest(s0+{s}, s1+{t})+e0, greatest(s0+{t}, s1+{s})+e1, CASE WHEN s1+{t} > s0+{s} THEN 1 ELSE 0 END, CASE WHEN s1+{s} > s0+{t} THEN 1 ELSE 0 END,
    (a0*{stay}+(1-a0)*{leave})*p0/((a0*{stay}+(1-a0)*{leave})*p0+(a0*{leave}+(1-a0)*{stay})*(1-p0)) FROM ahead h JOIN chain c ON h.deployment_id = c.deployment_id AND h.sensor_id = c.sensor_id AND h.seq = c.seq AND c.i = h.i+1
), behind AS (
  SELECT c.deployment_id, c.sensor_id, c.seq, c.i, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS state, 0.5e0 AS beta FROM chain c JOIN ahead h USING ({TRACK}, seq, i) WHERE c.i = c.n
  UNION ALL
  SELECT c.deployment_id, c.sensor_id, c.seq, c.i, CASE WHEN b.state = 0 THEN h.b0 ELSE h.b1 END,
    ({stay}*z.p0*beta+{leave}*(1-z.p0)*(1-beta))/({stay}*z.p0*beta+{leave}*(1-z.p0)*(1-beta)+{leave}*z.p0*beta+{stay}*(1-z.p0)*(1-beta))
  FROM behind b JOIN ahead h ON h.deployment_id = b.deployment_id AND h.sensor_id = b.sensor_id AND h.seq = b.seq AND h.i = b.i JOIN chain z ON z.deployment_id = b.deployment_id AND z.sensor_id = b.sensor_id AND z.seq = b.seq AND z.i = b.i
    JOIN chain c ON c.deployment_id = b.deployment_id AND c.sensor_id = b.sensor_id AND c.seq = b.seq AND c.i = b.i-1
), decoded AS (SELECT c.order_col, c.idle, b.state, h.a0*beta/(h.a0*beta+(1-h.a0)*(1-beta)) AS q FROM chain c JOIN ahead h USING ({TRACK}, seq, i) JOIN behind b USING ({TRACK}, seq, i))
SELECT f.order_col, d.q AS inactive_prob, CASE d.state WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' END AS activity_state, CASE d.state WHEN 0 THEN idle+1 WHEN 1 THEN 2-idle END AS activity_state_component FROM fixes f LEFT JOIN decoded d USING (order_col)"""


def map_points() -> str:
    return f"""WITH {FIXES} SELECT sensor_id AS map_group, row_number() OVER (PARTITION BY sensor_id ORDER BY datetime, order_col) AS seq, order_col, CASE WHEN state = 'view' THEN '#1a9641' ELSE '#808080' END AS color,
  '<b>sensor_id:</b> ' || sensor_id || '<br/><b>datetime:</b> ' || rtrim(rtrim(strftime(datetime, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') || '<br/>' AS popup FROM fixes"""


def playback(kind: str) -> str:
    w = "(PARTITION BY sensor_id ORDER BY datetime, order_col)"
    head = f"WITH {FIXES}, a AS (SELECT sensor_id AS map_group, row_number() OVER {w} AS seq, epoch_us(datetime) AS t, epoch_us(lead(datetime) OVER {w}) AS n FROM fixes), m AS (SELECT CAST(trunc(quantile_cont(n-t, 0.5)) AS BIGINT) AS step FROM a WHERE n-t > 0)"
    if kind == "points":
        return head + " SELECT map_group, seq, make_timestamp(t) AS start_time, make_timestamp(greatest(coalesce(n, t), t+step)) AS end_time FROM a, m"
    return head + " SELECT map_group, seq, make_timestamp(n) AS start_time, make_timestamp(n+step*19) AS end_time FROM a, m WHERE n IS NOT NULL"
