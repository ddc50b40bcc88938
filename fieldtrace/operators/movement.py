"""Steps, turning and movement by epoch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import stats
from fieldtrace.functions.epochs import _UNSET, EPOCH_COLUMNS, resolve_epoch, with_epochs
from fieldtrace.functions.geo import abs_turn_rad, bearing_deg, finite, haversine_m, is_finite
from fieldtrace.operators.tracks import ORDER, prepare, track_groups, with_order

STEP_COLUMNS = ["step_dt_s", "step_m", "speed_mps", "bearing_deg", "turn_rad", "cum_distance_m", "net_displacement_m"]


def gps_steps(df: DataFrame, groups: list[str] | None = None, order_col: str = ORDER) -> DataFrame:
    """Add what a fix adds to its track: step time, length, speed, bearing, turn, running length, net displacement.

    Steps never cross a segment; the running length carries on from one segment to the next without the gap.
    """
    df = with_order(prepare(df), order_col)
    track = track_groups(df, groups)
    steps = track + [c for c in ["segment_id"] if c in df.columns and c not in track]
    along = [c for c in track if c != "segment_id"]
    if "segment_id" in track and "sensor_id" not in along:
        along.append("sensor_id")
    w = Window.partitionBy(*steps).orderBy("datetime", order_col)
    lon, lat, plon, plat = F.col("lon"), F.col("lat"), F.lag("lon").over(w), F.lag("lat").over(w)
    dt = (F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(w))) / 1e6
    out = df.withColumns({
        "step_dt_s": dt, "step_m": haversine_m(plon, plat, lon, lat), "bearing_deg": bearing_deg(plon, plat, lon, lat),
        "net_displacement_m": haversine_m(F.first("lon").over(w), F.first("lat").over(w), lon, lat),
    })
    out = out.withColumn("turn_rad", abs_turn_rad(F.col("bearing_deg"), F.lag("bearing_deg").over(w)))
    out = out.withColumn("speed_mps", F.when(F.col("step_dt_s") > 0, F.col("step_m") / F.col("step_dt_s")))
    run = Window.partitionBy(*along).orderBy("datetime", order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("cum_distance_m", F.sum(F.coalesce("step_m", F.lit(0.0))).over(run))
    return out.select(*[c for c in df.columns if c not in STEP_COLUMNS], *STEP_COLUMNS)


def gps_turning(df: DataFrame, groups: list[str] | None = None, unit: str = "radians", order_col: str = ORDER) -> DataFrame:
    """Steps with turns in radians, degrees or both."""
    if unit not in ("radians", "degrees", "both"):
        raise ValueError(f"unknown unit {unit!r}")
    out = gps_steps(df, groups, order_col)
    if unit != "radians":
        out = out.withColumn("turn_deg", F.col("turn_rad") * 180 / math.pi)
    return out.drop("turn_rad") if unit == "degrees" else out


def gps_movement_summary(df: DataFrame, epoch=_UNSET, epoch_mins: float | None = None, groups: list[str] | None = None, order_col: str = ORDER, also: dict[str, Column] | None = None, apart: tuple[str, ...] = ()) -> DataFrame:
    """Movement by group and epoch. Steps into an epoch don't count in it; nor do turns at its first two fixes.

    ``also``: more aggregates over the same rows, by name, so that another block needs no pass of its own; the columns
    that they read are ``apart`` from those that describe a track.
    """
    level, mins = resolve_epoch(epoch, epoch_mins)
    df = prepare(df)
    grp = track_groups(df, groups)
    steps = grp + [c for c in ["segment_id"] if c in df.columns and c not in grp]
    moved = with_epochs(gps_steps(df, steps, order_col), level, mins)
    by = grp + EPOCH_COLUMNS
    w = Window.partitionBy(*grp, "epoch", "epoch_start", "epoch_end", "epoch_mins").orderBy(*[c for c in steps if c not in grp], "datetime", order_col)
    moved = moved.withColumn("_row", F.row_number().over(w))
    moved = moved.withColumns({
        "_step": F.when(F.col("_row") > 1, finite(F.col("step_m"))), "_speed": F.when(F.col("_row") > 1, finite(F.col("speed_mps"))), "_turn": F.when(F.col("_row") > 2, finite(F.col("turn_rad"))),
    })
    own = {*apart, *by, *STEP_COLUMNS, "turn_deg", "datetime", "lon", "lat", "_row", "_step", "_speed", "_turn", order_col, *steps}
    simple = {f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")}
    meta = [c for c in df.columns if c not in own and c in simple]
    at = F.struct("lon", "lat")
    out = moved.groupBy(*by).agg(
        *[stats.constant(c).alias(c) for c in meta],
        F.count(F.lit(1)).alias("n_fixes"), F.count("_step").alias("n_steps"), F.min("datetime").alias("start_datetime"), F.max("datetime").alias("end_datetime"),
        ((F.unix_micros(F.max("datetime")) - F.unix_micros(F.min("datetime"))) / 1e6).alias("span_s"),
        F.sum("_step").alias("total_distance_m"), F.min_by(at, "_row").alias("_first"), F.max_by(at, "_row").alias("_last"),
        F.avg("_step").alias("mean_step_m"), stats.quantile(F.col("_step"), 0.5).alias("median_step_m"), stats.quantile(F.col("_step"), 0.95).alias("p95_step_m"),
        F.avg("_speed").alias("mean_speed_mps"), F.max("_speed").alias("max_speed_mps"), stats.quantile(F.col("_speed"), 0.95).alias("p95_speed_mps"), F.avg("_turn").alias("mean_abs_turn_rad"),
        *[c.alias(n) for n, c in (also or {}).items()],
    )
    net = F.when(F.col("n_fixes") >= 2, haversine_m(F.col("_first.lon"), F.col("_first.lat"), F.col("_last.lon"), F.col("_last.lat")))
    out = out.withColumn("net_displacement_m", net).withColumn("straightness_index", F.when(F.col("total_distance_m") > 0, F.col("net_displacement_m") / F.col("total_distance_m")))
    metrics = ["n_fixes", "n_steps", "start_datetime", "end_datetime", "span_s", "total_distance_m", "net_displacement_m", "mean_step_m", "median_step_m", "p95_step_m", "mean_speed_mps", "max_speed_mps", "p95_speed_mps", "mean_abs_turn_rad", "straightness_index"]
    return out.select(*by, *meta, *metrics, *(also or {}))
