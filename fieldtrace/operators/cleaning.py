"""Cleaning with an audit trail: every step drops rows, or flags them, and keeps a lazy account of both."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geo, splines, stats
from fieldtrace.functions.epochs import _UNSET, resolve_epoch, with_epochs
from fieldtrace.functions.shapes import Shape, distance, holds, polygon
from fieldtrace.operators.layer_index import LayerTable, with_polygon
from fieldtrace.operators.spatial import metric_crs as zone
from fieldtrace.operators.spatial import project, project_point
from fieldtrace.operators.tracks import ORDER, as_instant, blank, join_by, prepare, require, time_groups, track_groups, with_order

#: States in which an animal doesn't move.
INACTIVE = ("inactive", "rest", "resting", "idle", "stationary", "lying", "ruminating")


@dataclass
class Cleaned:
    """The cleaned table, the rows a step removed or flagged, and one audit row per step. All are lazy."""

    data: DataFrame
    removed: DataFrame
    flagged: DataFrame
    summary: DataFrame
    parameters: dict = field(default_factory=dict)


def _audit(df: DataFrame, step: str, action: str, bad: Column, threshold: Column | None = None, notes: str = "") -> DataFrame:
    n, b = F.count(F.lit(1)), F.coalesce(F.sum(bad.cast("long")), F.lit(0))
    out = df.agg(n.alias("before_n"), b.alias("bad"), F.max(threshold if threshold is not None else F.lit(None).cast("double")).alias("threshold_mps"))
    drop = action == "drop"
    return out.select(
        F.lit(step).alias("step"), F.lit(action).alias("action"), "before_n", (F.col("before_n") - (F.col("bad") if drop else 0)).alias("after_n"),
        (F.col("bad") if drop else F.lit(0).cast("long")).alias("n_removed"), (F.lit(0).cast("long") if drop else F.col("bad")).alias("n_flagged"), "threshold_mps", F.lit(notes).alias("notes"),
    )


def _finish(marked: DataFrame, step: str, action: str, flag_col: str, columns: list[str], extra: list[str] = (), threshold: Column | None = None, notes: str = "", **parameters) -> Cleaned:
    if action not in ("drop", "flag"):
        raise ValueError(f"unknown action {action!r}")
    bad = F.col(flag_col)
    summary = _audit(marked, step, action, bad, threshold, notes)
    hit = marked.filter(bad).select(*columns, flag_col, *extra)
    none = hit.limit(0)
    if action == "drop":
        return Cleaned(marked.filter(~bad).select(*columns), hit, none, summary, parameters)
    return Cleaned(marked.select(*columns, flag_col, *extra), none, hit, summary, parameters)


def gps_clean_duplicates(df: DataFrame, keys: tuple[str, ...] = ("sensor_id", "datetime", "lon", "lat"), action: str = "drop", flag_col: str = "is_duplicate_fix", order_col: str = ORDER) -> Cleaned:
    """Keep the first row, in input order, of each key; nulls are equal."""
    require(df, *keys, order_col)
    marked = df.withColumn(flag_col, F.row_number().over(Window.partitionBy(*keys).orderBy(order_col)) > 1)
    return _finish(marked, "duplicates", action, flag_col, df.columns, keys=keys)


def gps_clean_errors(
    df: DataFrame, remove_invalid_datetime: bool = True, remove_invalid_coords: bool = True, remove_zero_zero: bool = True, window_start: str | None = None, window_end: str | None = None,
    deployment_windows: DataFrame | None = None, deployment_groups: list[str] | None = None, action: str = "drop", flag_col: str = "is_gps_error", reason_col: str = "gps_error_reason",
) -> Cleaned:
    """Blank sensors, bad times and coordinates, (0, 0), and fixes outside a window or their deployment's window."""
    df = prepare(df)
    lon, lat = F.col("lon"), F.col("lat")
    checks = [("missing_sensor_id", blank(F.col("sensor_id")))]
    if remove_invalid_datetime:
        checks.append(("invalid_datetime", F.col("datetime").isNull()))
    if remove_invalid_coords:
        checks.append(("invalid_coordinate", ~geo.valid_coordinate(lon, lat)))
    if remove_zero_zero:
        checks.append(("zero_zero", F.coalesce((lon == 0) & (lat == 0), F.lit(False))))
    outside, marked = F.lit(False), df
    if window_start is not None:
        outside = outside | F.coalesce(F.col("datetime") < as_instant(F.lit(window_start), window_start), F.lit(False))
    if window_end is not None:
        outside = outside | F.coalesce(F.col("datetime") > as_instant(F.lit(window_end), window_end), F.lit(False))
    if deployment_windows is not None:
        keys = deployment_groups or [c for c in ("deployment_id", "sensor_id") if c in df.columns and c in deployment_windows.columns]
        once = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1, F.raise_error(F.lit("deployment windows repeat a key")).cast("boolean")).otherwise(F.lit(True))
        bounds = deployment_windows.select(*keys, *[as_instant(F.col(f"{c}_datetime"), deployment_windows.schema[f"{c}_datetime"].dataType).alias(f"_{c}") for c in ("start", "end")], once.alias("_known"))
        marked = marked.join(bounds, keys, "left")
        checks.append(("missing_deployment_window", F.col("_known").isNull()))
        outside = outside | F.coalesce((F.col("datetime") < F.col("_start")) | (F.col("datetime") > F.col("_end")), F.lit(False))
    checks.append(("outside_deployment_window", outside))
    reason = F.concat_ws(";", *[F.when(test, F.lit(name)) for name, test in checks])
    marked = marked.withColumn(reason_col, reason).withColumn(flag_col, F.col(reason_col) != "")
    return _finish(marked, "errors", action, flag_col, df.columns, [reason_col])


def _speeds(df: DataFrame, groups: list[str] | None, order_col: str) -> DataFrame:
    grp = track_groups(df, groups)
    if groups is None and "segment_id" in df.columns:
        grp = [*grp, "segment_id"]
    w = Window.partitionBy(*grp).orderBy("datetime", order_col)
    dt = (F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(w))) / 1e6
    out = df.withColumns({"step_dt_s": dt, "step_m": geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))})
    return out.withColumn("speed_mps", F.when(F.col("step_dt_s") > 0, F.col("step_m") / F.col("step_dt_s")))


_SPEED = ["step_dt_s", "step_m", "speed_mps"]


def gps_clean_speed_fixed(df: DataFrame, max_speed_mps: float = 4, groups: list[str] | None = None, action: str = "drop", flag_col: str = "is_speed_outlier", keep_speed_cols: bool = False, order_col: str = ORDER) -> Cleaned:
    """Steps faster than a limit, in one pass: the jump out and the jump back."""
    df = with_order(prepare(df), order_col)
    marked = _speeds(df, groups, order_col).withColumn(flag_col, F.coalesce(F.col("speed_mps") > max_speed_mps, F.lit(False)))
    columns = [c for c in df.columns if c not in _SPEED] + (_SPEED if keep_speed_cols else [])
    return _finish(marked, "speed_fixed", action, flag_col, columns, threshold=F.lit(float(max_speed_mps)), max_speed_mps=max_speed_mps)


def _deviation_limit(counts: DataFrame, k: float) -> float | None:
    """The limit that log speeds of the upper quarter set, by their median and its absolute deviations.

    Each quantile needs the one before it, so they are found in turn; all come from the same counts of distinct speeds,
    and only they reach the driver.
    """
    counts = counts.persist()
    try:
        q = stats.quantiles(counts, {"q": 0.75}).first()
        if q is None or q["q"] is None:
            return None
        upper = counts.filter(F.col("v") >= q["q"])
        logs = upper.select(F.log1p("v").alias("v"), "n")
        m = stats.quantiles(logs, {"c": 0.5, "lo": 0.25, "hi": 0.75}).first()
        away = stats.quantiles(logs.select(F.abs(F.col("v") - m["c"]).alias("v"), "n"), {"d": 0.5}).first()["d"]
        s = 1.4826 * away if away > 0 else (m["hi"] - m["lo"]) / 1.349
        return math.expm1(m["c"] + k * s) if s > 0 else stats.quantiles(upper, {"top": 0.995}).first()["top"]
    finally:
        counts.unpersist()


def speed_threshold(speeds: DataFrame, method: str = "mad", k: float = 4, prob: float = 0.995, min_threshold_mps: float = 4) -> DataFrame:
    """One row, ``threshold_mps``: a limit that the positive speeds themselves set."""
    counts = stats.counted(speeds.filter("speed_mps > 0"), F.col("speed_mps"))
    if method == "quantile":
        found = stats.quantiles(counts, {"t": prob})
    elif method == "mad":
        found = speeds.sparkSession.range(1).select(F.lit(_deviation_limit(counts, k)).cast("double").alias("t"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return found.select(F.greatest(F.coalesce("t", F.lit(float(min_threshold_mps))), F.lit(float(min_threshold_mps))).alias("threshold_mps"))


def gps_clean_speed_stat(
    df: DataFrame, method: str = "mad", k: float = 4, prob: float = 0.995, min_threshold_mps: float = 4, groups: list[str] | None = None, action: str = "drop", flag_col: str = "is_speed_outlier", keep_speed_cols: bool = False, order_col: str = ORDER,
) -> Cleaned:
    """Steps faster than one limit that the data set (median absolute deviation of log speeds, or a quantile)."""
    df = with_order(prepare(df), order_col)
    speeds = _speeds(df, groups, order_col)
    limit = speed_threshold(speeds, method, k, prob, min_threshold_mps)
    marked = speeds.join(F.broadcast(limit)).withColumn(flag_col, F.coalesce(F.col("speed_mps") > F.col("threshold_mps"), F.lit(False)))
    columns = [c for c in df.columns if c not in _SPEED] + (_SPEED if keep_speed_cols else [])
    return _finish(marked, "speed_stat", action, flag_col, columns, threshold=F.col("threshold_mps"), method=method, k=k, prob=prob)


#: A polygon layer: a list of (name, ring or Shape), a ring being (lon, lat) vertices, which becomes part of the plan; or a
#: table of any size, which is joined through cells.
Polygons = list[tuple[str, list[tuple[float, float]] | Shape]] | LayerTable


def first_polygon(lon: Column, lat: Column, polygons: Polygons, buffer_m: float = 0, crs: int = 3857) -> Column:
    """Name of the first polygon in layer order that holds a point, edges included; with a buffer, in metres of EPSG:``crs``."""
    out = None
    if buffer_m > 0:
        x, y = project(lon, lat, crs)
    for name, area in polygons:
        area = area if isinstance(area, Shape) else polygon(area)
        hit = F.coalesce(distance(x, y, area.moved(lambda a, b: project_point(a, b, crs))) <= buffer_m, F.lit(False)) if buffer_m > 0 else holds(lon, lat, area)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def with_first_polygon(df: DataFrame, polygons: Polygons, buffer_m: float, crs: int) -> DataFrame:
    """Add ``_hit`` (whether any polygon holds a fix) and ``_p`` (the name of the first)."""
    if isinstance(polygons, LayerTable):
        x, y = project(F.col("lon"), F.col("lat"), crs) if buffer_m > 0 else (F.col("lon"), F.col("lat"))
        return with_polygon(df, x, y, polygons, crs if buffer_m > 0 else 4326, buffer_m).withColumns({"_hit": F.col("_no").isNotNull(), "_p": F.col("_name")}).drop("_no", "_name")
    return df.withColumn("_p", first_polygon(F.col("lon"), F.col("lat"), polygons, buffer_m, crs)).withColumn("_hit", F.col("_p").isNotNull())


def gps_append_paddock_names(
    df: DataFrame, polygons: Polygons, paddock_col: str = "assigned_paddock", buffer_m: float = 0, epoch=_UNSET, epoch_mins: float | None = None, groups: list[str] | None = None, min_prop: float = 0.7, min_fixes: int = 1,
    metric_crs: int | None = None,
) -> DataFrame:
    """The paddock that holds most fixes of a track and epoch, if at least ``min_prop`` of them; ties by name.

    A buffer is in metres of EPSG:``metric_crs``, by default the UTM zone of the fixes.
    """
    if buffer_m < 0 or not 0 < min_prop <= 1 or min_fixes < 1:
        raise ValueError("buffer_m must not be negative, min_prop in (0, 1], min_fixes 1 or more")
    level, mins = resolve_epoch(epoch, epoch_mins)
    df = prepare(df)
    grp = [c for c in (groups or time_groups(df)) if c != "segment_id"]
    ok = geo.valid_coordinate(F.col("lon"), F.col("lat")) & F.col("datetime").isNotNull()
    checked = df.withColumn("lon", F.when(ok, F.col("lon")).otherwise(F.raise_error(F.lit("invalid time or coordinate")).cast("double")))
    epochs = with_epochs(checked, level, mins).withColumnRenamed("epoch", "_epoch").drop("epoch_start", "epoch_end", "epoch_mins")
    at = with_first_polygon(epochs, polygons, buffer_m, zone(df, metric_crs) if buffer_m > 0 else 3857)
    counts = at.groupBy(*grp, "_epoch", "_p").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*grp, "_epoch")
    ranked = counts.withColumn("total", F.sum("n").over(w)).filter("_p is not null").withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), "_p")))
    best = ranked.filter((F.col("r") == 1) & (F.col("n") / F.col("total") >= min_prop) & (F.col("n") >= min_fixes)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(grp)], F.col("_epoch").alias("_e"), F.col("_p").alias(paddock_col))
    same = F.col("_epoch") == F.col("_e")
    for i, c in enumerate(grp):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return epochs.drop(paddock_col).join(best, same, "left").select(*[c for c in df.columns if c != paddock_col], paddock_col)


def gps_clean_spatial(df: DataFrame, polygons: Polygons, buffer_m: float = 100, append_paddock: bool = True, paddock_col: str = "paddock", action: str = "drop", flag_col: str = "is_outside_boundary") -> Cleaned:
    """Fixes outside every buffered polygon; each fix is assigned by itself to the first that holds it."""
    df = prepare(df)
    marked = with_first_polygon(df, polygons, max(buffer_m, 1e-9), 3857).withColumn(flag_col, ~F.col("_hit"))
    columns = df.columns
    if append_paddock:
        marked = marked.withColumn(paddock_col, F.col("_p"))
        columns = [c for c in df.columns if c != paddock_col] + [paddock_col]
    return _finish(marked, "spatial", action, flag_col, columns, buffer_m=buffer_m)


#: Points of a track that one smoothing block is for, and those of its neighbours that it looks at on each side: a point's
#: weight falls by e with every 45 points or less for the largest penalty.
BLOCK_POINTS, OVERLAP_POINTS = 4096, 1024
#: Rows of a track up to which it is smoothed as a whole, beside others.
WHOLE_POINTS = 4096


def _splined(rows: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """``order_col, lon, lat``: cubic smoothing splines along the rows of each group, by ``_no``; one penalty a group and
    coordinate, of least generalised cross-validation.

    Points are dealt to overlapping blocks. Blocks first give residuals and leverages for every penalty, whose sums choose
    one, and then the values of their own points. Under four finite points, and equal ones, stay as they are.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), geo.finite(F.col(c)).alias("y")) for c in ("lon", "lat")]))
    points = rows.select(*keys, order_col, "_no", pairs.alias("_p")).filter("_p.y is not null").select(*keys, order_col, F.col("_no").cast("double").alias("x"), F.col("_p.c").alias("_c"), F.col("_p.y").alias("y"))
    by = [*keys, "_c"]
    points = points.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("x")) - 1)
    home, at = F.floor(F.col("_r") / BLOCK_POINTS), F.col("_r") % BLOCK_POINTS
    blocks = F.array_compact(F.array(home, F.when((at < OVERLAP_POINTS) & (home > 0), home - 1), F.when(at >= BLOCK_POINTS - OVERLAP_POINTS, home + 1)))
    points = points.withColumns({"_home": home, "_block": F.explode(blocks)}).withColumn("_own", F.col("_home") == F.col("_block")).drop("_home", "_r")

    def known(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
        table = table.sort_by("x")
        return table.column("x").to_numpy(), table.column("y").to_numpy(), table.column("_own").to_numpy(zero_copy_only=False), table

    def tried(table: pa.Table) -> pa.Table:
        x, y, own, table = known(table)
        n = len(splines.PENALTIES) if own.any() and len(x) > 3 else 0
        rss, leverage = splines.scores(x, y - y.mean(), own) if n else (np.empty(0),) * 2
        lows = pa.array([y.min()] * n, pa.float64()), pa.array([y.max()] * n, pa.float64())
        return pa.table({**{c: pa.chunked_array([pa.repeat(table.column(c)[0], n)]) for c in by}, "_k": pa.array(np.arange(n, dtype=np.int32)), "_rss": pa.array(rss), "_lev": pa.array(leverage), "_n": pa.array([int(own.sum())] * n, pa.int64()), "_lo": lows[0], "_hi": lows[1]})

    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    sums = points.groupBy(*by, "_block").applyInArrow(tried, f"{kinds}, _k int, _rss double, _lev double, _n long, _lo double, _hi double").groupBy(*by, "_k").agg(*[F.sum(c).alias(c) for c in ("_rss", "_lev", "_n")], F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    loose = F.greatest(1 - F.col("_lev") / F.col("_n"), F.lit(1e-9))
    best = sums.filter("_hi > _lo").groupBy(*by).agg(F.min_by("_k", F.struct(F.col("_rss") / F.col("_n") / loose / loose, "_k")).alias("_k"))

    def fitted(table: pa.Table) -> pa.Table:
        x, y, own, table = known(table)
        value = y.mean() + splines.fit(x, y - y.mean(), splines.PENALTIES[table.column("_k")[0].as_py()]) if own.any() and len(x) > 3 else y
        return pa.table({order_col: table.column(order_col).filter(pa.array(own)), "_c": table.column("_c").filter(pa.array(own)), "_v": pa.array(value[own])})

    values = join_by(points, best, by).groupBy(*by, "_block").applyInArrow(fitted, f"`{order_col}` {points.schema[order_col].dataType.simpleString()}, _c string, _v double")
    return values.groupBy(order_col).agg(*[F.max(F.when(F.col("_c") == c, F.col("_v"))).alias(f"_{c}") for c in ("lon", "lat")])


def _middles(v: np.ndarray, run: np.ndarray, runs: int) -> np.ndarray:
    """The median of the finite values of each run; NaN where there are none."""
    ok = np.isfinite(v)
    v, run = v[ok], run[ok]
    n = np.bincount(run, minlength=runs)
    first, v = np.cumsum(n) - n, v[np.lexsort((v, run))]
    some, out = np.flatnonzero(n), np.full(runs, np.nan)
    out[some] = 0.5 * v[(first + (n - 1) // 2)[some]] + 0.5 * v[(first + n // 2)[some]]
    return out


def _denoised_runs(table: pa.Table) -> pa.Table:
    """Whole runs of rows (from ``_begins`` on) with smoothed coordinates; idle runs at their median."""
    begins, idle = (table.column(c).to_numpy() for c in ("_begins", "_idle"))
    starts = np.flatnonzero(begins)
    n, run, idle = np.diff(starts, append=len(begins)), np.cumsum(begins) - 1, idle[starts]
    values = {c: table.column(c).to_numpy() for c in ("lon", "lat")}
    middle = {c: _middles(v, run, len(n)) for c, v in values.items()}
    rest = idle & ~np.isnan(middle["lon"]) & ~np.isnan(middle["lat"])
    for c, v in values.items():
        ok = np.isfinite(v)
        have = np.add.reduceat(ok.astype(np.int64), starts)
        low, high = np.minimum.reduceat(np.where(ok, v, np.inf), starts), np.maximum.reduceat(np.where(ok, v, -np.inf), starts)
        bent = ~idle & (have > 3) & (high > low)
        even, new = bent & (have == n), np.where(rest, middle[c], np.nan)[run]
        rows = even[run]
        new[rows] = splines.smoothed(v[rows], n[even])
        for k in np.flatnonzero(bent & ~even):  # points that miss others between them
            own = slice(starts[k], starts[k] + n[k])
            x, y, at = np.flatnonzero(ok[own]).astype(float), v[own][ok[own]], starts[k] + np.flatnonzero(ok[own])
            rss, leverage = splines.scores(x, y - y.mean(), np.ones(len(x), bool))
            score = rss / len(x) / np.maximum(1 - leverage / len(x), 1e-9) ** 2
            new[at] = y.mean() + splines.fit(x, y - y.mean(), splines.PENALTIES[score.argmin()])
        i = table.column_names.index(c)
        table = table.set_column(i, c, pc.coalesce(pa.array(new, mask=~(rest | bent)[run] | np.isnan(new)), table.column(c).combine_chunks()))
    return table.drop_columns(["_begins", "_idle"])


def _denoised(rows: DataFrame) -> DataFrame:
    """Rows of tracks that fit into a block, in the order of their tracks, with coordinates smoothed run by run, many runs at once."""

    def denoised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("_begins").to_numpy(zero_copy_only=False))
            if len(starts):  # the run that begins last may go on in the next batch
                held.append(b.slice(0, starts[-1]))
                if sum(h.num_rows for h in held):
                    yield from _denoised_runs(pa.Table.from_batches(held).combine_chunks()).to_batches()
                b, held = b.slice(starts[-1]), []
            held.append(b)
        if held:
            yield from _denoised_runs(pa.Table.from_batches(held).combine_chunks()).to_batches()

    kept = rows.drop("_begins", "_idle")
    return rows.mapInArrow(denoised, kept.schema)


def _denoised_long(raw: DataFrame, grp: list[str], order_col: str) -> DataFrame:
    """The same for longer tracks, in blocks."""
    w = Window.partitionBy(*grp).orderBy("datetime", order_col)
    raw = raw.withColumns({"_no": F.row_number().over(w), "_change": F.coalesce((F.col("_idle") != F.lag("_idle").over(w)).cast("int"), F.lit(1))})
    raw = raw.withColumn("_run", F.sum("_change").over(w)).drop("_change")
    rest = raw.filter("_idle").groupBy(*grp, "_run").agg(*[F.median(geo.finite(F.col(c))).alias(f"_mid_{c}") for c in ("lon", "lat")])
    raw = join_by(raw, rest, [*grp, "_run"], "left")
    both = F.col("_mid_lon").isNotNull() & F.col("_mid_lat").isNotNull()
    raw = raw.withColumns({c: F.when(both, F.col(f"_mid_{c}")).otherwise(F.col(c)) for c in ("lon", "lat")}).drop("_mid_lon", "_mid_lat")
    smooth = _splined(raw.filter(~F.col("_idle")), [*grp, "_run"], order_col)
    return raw.join(smooth, order_col, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("lon", "lat")})


def gps_denoise(df: DataFrame, method: str = "statistical", state_col: str | None = None, inactive_states: tuple[str, ...] = INACTIVE, groups: list[str] | None = None, keep_raw_coords: bool = True, order_col: str = ORDER) -> Cleaned:
    """Smooth coordinates along each track: a spline, or with states the median of each inactive run and a spline elsewhere.

    The spline is the cubic smoothing spline over the rows' places in their track (or active run). Rows of a null group,
    and tracks with under four finite points, stay as they are; so does an inactive run without a finite median of both
    coordinates. Tracks that fit into a block are worked on many at once, longer ones in blocks.
    """
    df = with_order(prepare(df), order_col)
    grp = track_groups(df, groups)
    raw = df.withColumns({"lon_raw": F.col("lon"), "lat_raw": F.col("lat")})
    known = F.lit(True)
    for c in grp:
        known = known & F.col(c).isNotNull()
    if method == "state_aware":
        require(df, state_col or "activity_state")
        state = F.lower(F.trim(F.col(state_col or "activity_state").cast("string")))
        idle = F.coalesce(state.isin(*inactive_states), F.lit(False)) & known
    elif method == "statistical":
        idle = F.lit(False)
    else:
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy(*grp).orderBy("datetime", order_col)
    # A table of the tracks that are longer: a row for each WHOLE_POINTS rows at most.
    long = df.filter(known).groupBy(*grp).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE_POINTS).drop("_n")
    whole = long.isEmpty()
    short = raw if whole else join_by(raw, F.broadcast(long), grp, "left_anti")
    begins = F.coalesce(F.col("_idle") != F.lag("_idle").over(w), F.lit(True)) | ~known
    done = _denoised(short.withColumn("_idle", idle).withColumn("_begins", begins)).select(*raw.columns)
    if not whole:
        done = done.unionByName(_denoised_long(join_by(raw, F.broadcast(long), grp, "left_semi").withColumn("_idle", idle), grp, order_col).select(*raw.columns))
    out = done if keep_raw_coords else done.drop("lon_raw", "lat_raw")
    none = out.limit(0)
    return Cleaned(out, none, none, _audit(df, "denoise", "adjust", F.lit(False), notes=method).withColumn("action", F.lit("adjust")), {"method": method})


def gps_clean(
    df: DataFrame, steps: tuple[str, ...] = ("duplicates", "errors", "speed_fixed", "denoise"), action: str = "drop", polygons: Polygons | None = None, max_speed_mps: float = 4, speed_stat_method: str = "mad",
    window_start: str | None = None, window_end: str | None = None, deployment_windows: DataFrame | None = None, deployment_groups: list[str] | None = None, buffer_m: float = 100, append_paddock: bool = True,
    paddock_col: str = "paddock", denoise_method: str = "statistical", denoise_state_col: str | None = None, step_args: dict[str, dict] | None = None, groups: list[str] | None = None, order_col: str = ORDER,
) -> Cleaned:
    """The steps in order, as one lazy plan with one audit row each; ``step_args`` override a step's arguments."""
    known = ("duplicates", "errors", "speed_fixed", "speed_stat", "spatial", "denoise")
    if bad := [s for s in steps if s not in known]:
        raise ValueError("unknown steps: " + ", ".join(bad))
    data, summaries, removed, flagged = df, [], [], []
    for step in steps:
        more = (step_args or {}).get(step, {})
        if step == "duplicates":
            done = gps_clean_duplicates(data, **({"action": action, "order_col": order_col} | more))
        elif step == "errors":
            done = gps_clean_errors(data, **({"window_start": window_start, "window_end": window_end, "deployment_windows": deployment_windows, "deployment_groups": deployment_groups, "action": action} | more))
        elif step == "speed_fixed":
            done = gps_clean_speed_fixed(data, **({"max_speed_mps": max_speed_mps, "groups": groups, "action": action, "order_col": order_col} | more))
        elif step == "speed_stat":
            done = gps_clean_speed_stat(data, **({"method": speed_stat_method, "min_threshold_mps": max_speed_mps, "groups": groups, "action": action, "order_col": order_col} | more))
        elif step == "spatial":
            if polygons is None:
                raise ValueError("the spatial step needs polygons")
            done = gps_clean_spatial(data, polygons, **({"buffer_m": buffer_m, "append_paddock": append_paddock, "paddock_col": paddock_col, "action": action} | more))
        else:
            done = gps_denoise(data, **({"method": denoise_method, "state_col": denoise_state_col, "groups": groups, "order_col": order_col} | more))
        data = done.data
        summaries.append(done.summary.withColumn("step_no", F.lit(len(summaries) + 1)))
        removed.append(done.removed.withColumn("clean_step", F.lit(step)))
        flagged.append(done.flagged.withColumn("clean_step", F.lit(step)))

    def stacked(tables: Iterator[DataFrame]) -> DataFrame:
        first, *rest = tables
        for t in rest:
            first = first.unionByName(t, allowMissingColumns=True)
        return first

    return Cleaned(data, stacked(removed), stacked(flagged), stacked(summaries), {"steps": steps})
