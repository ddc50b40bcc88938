"""Time grids: snapping, interpolation and downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import stats
from fieldtrace.functions.geo import valid_coordinate
from fieldtrace.operators.tracks import ORDER, prepare, time_groups, with_order


def _known(df: DataFrame, groups: list[str]) -> DataFrame:
    """Rows with a time and a value in each group column: the others are on no grid."""
    return df.filter(" and ".join(f"`{c}` is not null" for c in [*groups, "datetime"]))


def base_interval_mins(df: DataFrame, groups: list[str]) -> DataFrame:
    """One row, ``mins``: the median positive gap of all groups in whole minutes, at least 1."""
    w = Window.partitionBy(*groups).orderBy("datetime")
    gap = df.select(((F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(w))) / 60e6).alias("g")).filter("g > 0")
    middle = stats.quantiles(stats.counted(gap, F.col("g")), {"g": 0.5})
    return middle.select(F.greatest(F.rint(F.coalesce("g", F.lit(1.0))), F.lit(1.0)).alias("mins"))


def _with_interval(df: DataFrame, groups: list[str], interval_mins: float | str) -> DataFrame:
    """Add ``_step``, the grid step in microseconds."""
    if interval_mins == "base":
        return df.join(F.broadcast(base_interval_mins(df, groups))).withColumn("_step", (F.greatest(F.rint(F.col("mins") * 60), F.lit(1.0)) * 1e6).cast("long")).drop("mins")
    if not float(interval_mins) > 0:
        raise ValueError("interval_mins must be positive")
    return df.withColumn("_step", F.lit(max(1, round(float(interval_mins) * 60)) * 1_000_000).cast("long"))


#: Grid steps of a block: blocks of a track are worked on apart, so that no task holds a whole track.
BLOCK_STEPS = 4096


def _block(t: Column) -> Column:
    return F.floor(t / (F.col("_step") * BLOCK_STEPS))


def _grid(df: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, _t``: the grid of each group, all with the phase of the Unix epoch, written out block by block."""
    span = df.groupBy(*groups).agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.first("_step").alias("_step"))
    span = span.withColumns({"lo": (F.floor(F.col("lo") / F.col("_step")) * F.col("_step")).cast("long"), "hi": (F.ceil(F.col("hi") / F.col("_step")) * F.col("_step")).cast("long")})
    blocks = span.withColumn("_block", F.explode(F.sequence(_block(F.col("lo")), _block(F.col("hi")))))
    first, width = F.col("_block") * F.col("_step") * BLOCK_STEPS, F.col("_step") * BLOCK_STEPS
    return blocks.select(*groups, "_step", F.explode(F.sequence(F.greatest("lo", first), F.least(F.col("hi"), first + width - F.col("_step")), F.col("_step"))).alias("_t"))


def _filled(df: DataFrame, out: DataFrame, groups: list[str], skip: list[str]) -> DataFrame:
    """Fill columns that hold one value in a whole group."""
    extra = [c for c in df.columns if c not in {*groups, *skip} and dict(df.dtypes)[c] in ("string", "boolean", "int", "bigint", "double", "date", "timestamp")]
    if not extra:
        return out
    same = df.groupBy(*groups).agg(*[F.when((F.min(c) == F.max(c)) & (F.count(c) > 0), F.min(c)).alias(f"_c_{c}") for c in extra])
    return out.join(same, groups, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in extra if c in out.columns}).drop(*[f"_c_{c}" for c in extra])


def gps_regularise(df: DataFrame, interval_mins: float | str = "base", tolerance_mins: float | None = None, groups: list[str] | None = None, keep_extra: bool = True, order_col: str = ORDER) -> DataFrame:
    """Snap fixes to a regular grid: the nearest fix of each grid time within the tolerance (half a step), or none."""
    df = with_order(prepare(df), order_col)
    grp = time_groups(df, groups)
    fixes = _with_interval(_known(df, grp), grp, interval_mins).withColumn("_t", F.unix_micros("datetime"))
    tolerance = F.col("_step") / 2 if tolerance_mins is None else F.lit(float(tolerance_mins) * 60e6)
    lows = fixes.groupBy(*grp).agg(F.min("_t").alias("_low"))  # a row for each track: joined, so that no window holds one
    start = (F.floor(F.col("_low") / F.col("_step")) * F.col("_step")).cast("long")
    near = fixes.join(lows, grp).withColumn("_g", (start + F.rint((F.col("_t") - start) / F.col("_step")) * F.col("_step")).cast("long")).withColumn("_off", F.col("_t") - F.col("_g")).filter(F.abs("_off") <= tolerance)
    w = Window.partitionBy(*grp, "_g").orderBy(F.abs("_off"), order_col)
    extra = [c for c in df.columns if c not in {*grp, "datetime", "lon", "lat", order_col}] if keep_extra else []
    best = near.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*grp, F.col("_g").alias("_t"), "lon", "lat", *extra, F.col("datetime").alias("observed_datetime"), (F.col("_off") / 1e6).alias("time_offset_s"))
    out = _grid(fixes, grp).drop("_step").join(best, [*grp, "_t"], "left").withColumn("datetime", F.timestamp_micros("_t")).withColumn("is_observed", F.col("observed_datetime").isNotNull())
    out = _filled(df, out, grp, ["datetime", "lon", "lat", order_col])
    return out.select(*grp, "datetime", "lon", "lat", *extra, "observed_datetime", "time_offset_s", "is_observed")


def gps_interpolate(df: DataFrame, interval_mins: float | str = "base", groups: list[str] | None = None, keep_extra: bool = True, order_col: str = ORDER) -> DataFrame:
    """Linear interpolation at grid times between the fixes around them; never beyond the first or last fix.

    Segments are always tracks of their own. Anchors are fixes with valid coordinates, the first of each time. Grid and
    the anchors next to its times meet in blocks of a track's time; running windows find the anchors around a row inside its block, and a table
    of blocks carries the nearest ones over from other blocks. Work is linear in rows, and no task holds a whole track.
    """
    if {"is_observed", "is_interpolated"} <= set(df.columns):
        raise ValueError("the table is on a grid already")
    df = with_order(prepare(df), order_col)
    grp = time_groups(df, groups)
    grp += [c for c in ["segment_id"] if c in df.columns and c not in grp]
    fixes = _with_interval(_known(df, grp), grp, interval_mins).withColumn("_t", F.unix_micros("datetime"))
    extra = [c for c in df.columns if c not in {*grp, "datetime", "lon", "lat", order_col}] if keep_extra else []
    held = ["lon", "lat", *extra]
    anchors = fixes.filter(valid_coordinate(F.col("lon"), F.col("lat"))).groupBy(*grp, "_step", "_t").agg(F.min_by(F.struct(order_col, *held), order_col).alias("_fix"))
    # Of the anchors of a grid step only the first and the last are next to a grid time: a block holds as many rows as steps.
    ends = anchors.groupBy(*grp, "_step", F.floor(F.col("_t") / F.col("_step")).alias("_g")).agg(*[f(F.struct("_t", "_fix"), "_t").alias(n) for n, f in (("_first", F.min_by), ("_last", F.max_by))])
    ends = ends.select(*grp, "_step", F.explode(F.when(F.col("_first._t") == F.col("_last._t"), F.array("_first")).otherwise(F.array("_first", "_last"))).alias("_end"))
    anchors = ends.select(*grp, F.col("_end._t").alias("_t"), "_step", F.col("_end._fix").alias("_fix"), F.lit(False).alias("_grid"))
    both = _grid(fixes, grp).withColumn("_grid", F.lit(True)).unionByName(anchors, allowMissingColumns=True).withColumn("_block", _block(F.col("_t")))
    both = both.repartition(*grp, "_block")  # the grouping and the windows below keep to it
    merged = both.groupBy(*grp, "_block", "_t").agg(F.max("_grid").alias("_grid"), F.min_by("_fix", f"_fix.{order_col}").alias("_fix"))
    merged = merged.select(*grp, "_block", "_t", "_grid", *[F.col(f"_fix.{c}").alias(c) for c in held], F.col("_fix").isNotNull().alias("_anchor"))
    a = F.when(F.col("_anchor"), F.struct("_t", "lon", "lat"))
    edges = merged.groupBy(*grp, "_block").agg(F.min(a).alias("_first"), F.max(a).alias("_last"))
    track = Window.partitionBy(*grp)
    edges = edges.select(
        *grp, "_block", F.last("_last", True).over(track.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", True).over(track.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    block = Window.partitionBy(*grp, "_block")
    past, ahead = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_t"), F.desc("_t")))
    out = merged.withColumns({"_p": F.last(a, True).over(past), "_n": F.last(a, True).over(ahead)}).filter("_grid").join(edges, [*grp, "_block"])
    out = out.withColumns({"_p": F.coalesce("_p", "_before"), "_n": F.coalesce("_n", "_after")})
    can = ~F.col("_anchor") & F.col("_p").isNotNull() & F.col("_n").isNotNull()
    weight = (F.col("_t") - F.col("_p._t")) / (F.col("_n._t") - F.col("_p._t"))
    line = lambda c: F.when(F.col("_anchor"), F.col(c)).when(can, F.col(f"_p.{c}") + weight * (F.col(f"_n.{c}") - F.col(f"_p.{c}")))
    out = out.select(
        *grp, F.timestamp_micros("_t").alias("datetime"), line("lon").alias("lon"), line("lat").alias("lat"), *extra, F.when(F.col("_anchor"), F.timestamp_micros("_t")).alias("observed_datetime"),
        F.when(F.col("_anchor"), 0.0).alias("time_offset_s"), F.col("_anchor").alias("is_observed"), can.alias("is_interpolated"), F.when(can, (F.col("_n._t") - F.col("_p._t")) / 1e6).alias("interpolation_gap_s"),
    )
    return _filled(df, out, grp, ["datetime", "lon", "lat", order_col])


def gps_downsample(df: DataFrame, target_mins: float, method: str = "representative", phase_mins: float = 0, groups: list[str] | None = None, order_col: str = ORDER) -> DataFrame:
    """One fix per coarse window: the first in it (``rigid``), or the nearest to its centre (``representative``)."""
    if not target_mins > 0:
        raise ValueError("target_mins must be positive")
    df = with_order(prepare(df), order_col)
    grp = time_groups(df, groups)
    step = round(target_mins * 60) * 1_000_000
    phase = round(phase_mins * 60) * 1_000_000 % step
    fixes = _known(df, grp).withColumn("_t", F.unix_micros("datetime"))
    fixes = fixes.join(fixes.groupBy(*grp).agg((F.min("_t") + phase).alias("_t0"), F.max("_t").alias("_t1")), grp)
    fixes = fixes.withColumn("_n", F.when(F.col("_t0") <= F.col("_t1"), F.floor((F.col("_t1") - F.col("_t0")) / step) + 1).otherwise(0))
    rel = (F.col("_t") - F.col("_t0")) / step
    if method == "rigid":
        k, order = F.floor(rel), ["_t", order_col]
    elif method == "representative":
        k, order = F.floor(rel + 0.5), [F.abs(F.col("_t") - (F.col("_t0") + F.col("_k") * step)), "_t", order_col]
    else:
        raise ValueError(f"unknown method {method!r}")
    fixes = fixes.withColumn("_k", k).filter("_k >= 0 and _k < _n")
    return fixes.withColumn("_r", F.row_number().over(Window.partitionBy(*grp, "_k").orderBy(*order))).filter("_r = 1").select(*df.columns)


def grid_diagnostics(df: DataFrame, grid: DataFrame, groups: list[str]) -> DataFrame:
    """By group: fixes, grid rows, how many are observed or interpolated, offsets, and the gaps of the fixes."""
    w = Window.partitionBy(*groups).orderBy("datetime")
    gaps = df.select(*groups, ((F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(w))) / 60e6).alias("gap")).groupBy(*groups).agg(F.count(F.lit(1)).alias("n_fixes"), F.median("gap").alias("median_gap_mins"), F.max("gap").alias("max_gap_mins"))
    filled = F.col("is_interpolated").cast("long") if "is_interpolated" in grid.columns else F.lit(0).cast("long")
    made = grid.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_grid"), F.sum(F.col("is_observed").cast("long")).alias("n_observed"), F.sum(filled).alias("n_interpolated"),
        stats.mean(F.abs("time_offset_s")).alias("mean_abs_offset_s"), F.max(F.abs("time_offset_s")).alias("max_abs_offset_s"),
    )
    return gaps.join(made, groups, "inner").withColumn("prop_observed", stats.proportion(F.col("n_observed"), F.col("n_grid")))


def _gaps(df: DataFrame, groups: list[str]) -> DataFrame:
    """By group: how many positive gaps lie between its distinct times, and the least, the middle and the longest, in seconds."""
    w = Window.partitionBy(*groups).orderBy("datetime")
    gap = (F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(w))) / 1e6
    gaps = df.filter("datetime is not null").select(*groups, "datetime").distinct().withColumn("_gap", gap)
    return gaps.groupBy(*groups).agg(F.count("_gap").alias("n_observed_gaps"), F.min("_gap").alias("gap_min_s"), F.median("_gap").alias("gap_median_s"), F.max("_gap").alias("gap_max_s"))


def temporal_diagnostics(df: DataFrame, out: DataFrame, kind: str, interval_mins: float | str, tolerance_mins: float | None = None, phase_mins: float = 0, groups: list[str] | None = None) -> DataFrame:
    """What ``gps_regularise``, ``gps_interpolate`` or ``gps_downsample`` (``kind``) made of a table, by group.

    ``df`` is what went in, ``out`` what came out. Counts of fixes, times and duplicates, what is on the grid, filled or
    left; gaps between times (of fixes, of anchors when interpolating, of retained fixes when downsampling); the interval
    aimed at and the one reached; and the parameters. Rows without a time are counted over the whole table.
    """
    if kind not in ("regularise", "interpolate", "downsample"):
        raise ValueError(f"unknown kind {kind!r}")
    df = prepare(df)
    grp = time_groups(df, groups)
    grp += [c for c in ["segment_id"] if kind == "interpolate" and c in df.columns and c not in grp]
    known, flag = _known(df, grp), lambda t, c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")) if c in t.columns else F.lit(0).cast("long")
    anchors = known.filter(valid_coordinate(F.col("lon"), F.col("lat")))
    seen = known.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("n_observed_fixes"), F.countDistinct("datetime").alias("n_observed_timestamps"), F.sum((~valid_coordinate(F.col("lon"), F.col("lat"))).cast("long")).alias("n_invalid_coordinate_fixes"),
        F.countDistinct(F.when(valid_coordinate(F.col("lon"), F.col("lat")), F.col("datetime"))).alias("n_valid_anchor_timestamps"), F.min("datetime").alias("_first"), F.max("datetime").alias("_last"),
    )
    offset = F.abs("time_offset_s") if "time_offset_s" in out.columns else F.lit(None).cast("double")
    made = out.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("_rows"), flag(out, "is_observed").alias("n_observed_on_grid"), flag(out, "is_interpolated").alias("n_interpolated"), F.sum((F.col("lon").isNull() | F.col("lat").isNull()).cast("long")).alias("n_unfilled_grid_fixes"),
        F.median(offset).alias("median_abs_time_offset_s"), F.max(offset).alias("max_abs_time_offset_s"),
    )
    reached = _gaps(out, grp).select(*grp, F.col("gap_median_s").alias("sampling_interval_achieved_s"))
    gaps = _gaps({"regularise": known, "interpolate": anchors, "downsample": out}[kind], grp)
    all_ = seen.join(made, grp, "left").join(gaps, grp, "left").join(reached, grp, "left")
    all_ = all_.join(F.broadcast(df.agg(F.sum(F.col("datetime").isNull().cast("long")).alias("n_missing_datetime"))))
    all_ = _with_interval_column(all_, known, grp, interval_mins)
    target = F.col("sampling_interval_target_s")
    if kind == "downsample":
        step = (target * 1e6).cast("long")
        start = F.unix_micros("_first") + F.lit(round(phase_mins * 60) * 1_000_000) % step
        expected = F.when(start <= F.unix_micros("_last"), F.floor((F.unix_micros("_last") - start) / step) + 1).otherwise(0)
    else:
        expected = F.col("_rows")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("_rows", "n_observed_on_grid", "n_interpolated", "n_unfilled_grid_fixes", "n_observed_gaps")}
    all_ = all_.withColumns({**zero, "n_expected_fixes": expected, "n_duplicate_timestamps": F.col("n_observed_fixes") - F.col("n_observed_timestamps")})
    all_ = all_.withColumns({
        "prop_interpolated": stats.proportion(F.col("n_interpolated"), F.col("n_expected_fixes")), "n_unmatched_observed_fixes": F.greatest(F.col("n_observed_fixes") - F.col("n_observed_on_grid"), F.lit(0)), "n_retained_fixes": F.col("_rows"),
        "tolerance_mins": F.lit(float(tolerance_mins)) if tolerance_mins is not None else target / 120, "interval_mins": target / 60, "phase_mins": F.lit(float(phase_mins)),
    })
    ends = ["n_observed_gaps", "gap_min_s", "gap_median_s", "gap_max_s", "sampling_interval_target_s", "sampling_interval_achieved_s", "interval_mins"]
    columns = {
        "regularise": ["n_expected_fixes", "n_observed_fixes", "n_observed_timestamps", "n_observed_on_grid", "n_unmatched_observed_fixes", "n_interpolated", "prop_interpolated", "n_duplicate_timestamps", "n_missing_datetime", "median_abs_time_offset_s", "max_abs_time_offset_s", "tolerance_mins", *ends],
        "interpolate": ["n_expected_fixes", "n_observed_fixes", "n_observed_timestamps", "n_valid_anchor_timestamps", "n_observed_on_grid", "n_interpolated", "n_unfilled_grid_fixes", "prop_interpolated", "n_duplicate_timestamps", "n_invalid_coordinate_fixes", "n_missing_datetime", *ends],
        "downsample": ["n_expected_fixes", "n_observed_fixes", "n_retained_fixes", "n_interpolated", "prop_interpolated", "n_missing_datetime", *ends, "phase_mins"],
    }
    return all_.select(*grp, *columns[kind])


def _with_interval_column(table: DataFrame, known: DataFrame, groups: list[str], interval_mins: float | str) -> DataFrame:
    if interval_mins == "base":
        return table.join(F.broadcast(base_interval_mins(known, groups).select((F.col("mins") * 60.0).alias("sampling_interval_target_s"))))
    return table.withColumn("sampling_interval_target_s", F.lit(float(max(1, round(float(interval_mins) * 60)))))
