"""Epoch tables: metric blocks merged on their common keys, and roll-ups of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.epochs import _UNSET, EPOCH_COLUMNS, resolve_epoch, utc_date
from fieldtrace.operators.movement import gps_movement_summary
from fieldtrace.operators.social import THRESHOLDS, gps_social, gps_social_summary, social_metrics
from fieldtrace.operators.spatial import gps_spatial
from fieldtrace.operators.tracks import ORDER, require, summary_groups

#: Columns that can key a metric table, in order.
KEYS = ["deployment_id", "animal_id", "sensor_id", "herd_id", "group_id", "paddock", "treatment", *EPOCH_COLUMNS, "period_type", "period", "date", "hour", "week"]
BLOCKS = ("movement", "social", "spatial", "resource_use")


def merge_metric_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge on the key columns that all tables have; a later table's clashing columns get its name in front.

    The tables are stacked and grouped by key once, however many they are; nulls in keys are equal. Where a table has
    several rows of a key, each meets each row of the others.
    """
    keys = [k for k in KEYS if all(k in t.columns for t in tables.values())]
    if not keys:
        raise ValueError("the tables share no key column")
    if len(tables) == 1:
        (only,) = tables.values()
        return only.select(*keys, *[c for c in only.columns if c not in keys])
    taken, parts, columns = set(keys), [], []
    for k, (name, t) in enumerate(tables.items()):
        own = {c: f"{name}_{c}" if k and c in taken else c for c in t.columns if c not in keys}
        taken |= set(own.values())
        columns.append(list(own.values()))
        parts.append(t.select(*keys, F.struct(*[F.col(c).alias(n) for c, n in own.items()], F.lit(True).alias("_here")).alias(f"_b{k}")))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = stacked.groupBy(*keys).agg(*[F.collect_list(f"_b{k}").alias(f"_b{k}") for k in range(len(parts))])
    for k in range(len(parts)):
        out = out.withColumn(f"_b{k}", F.explode_outer(f"_b{k}"))
    return out.select(*keys, *[F.col(f"_b{k}")[c].alias(c) for k, own in enumerate(columns) for c in own])


def resource_roll_up(use: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Resource use over all resources, by group and epoch; the mean distance is weighted by fixes."""
    require(use, *EPOCH_COLUMNS, "resource_id", "n_fixes", "n_fixes_near", "mean_distance_m")
    grp = summary_groups(use, groups)
    total = F.coalesce(F.max("n_total_fixes"), F.sum("n_fixes")) if "n_total_fixes" in use.columns else F.sum("n_fixes")
    return use.groupBy(*grp, *EPOCH_COLUMNS).agg(
        F.countDistinct("resource_id").alias("n_resources"), F.sum("n_fixes").alias("n_resource_fix_rows"), F.sum("n_fixes_near").alias("n_fixes_near_resource"), F.try_divide(F.sum("n_fixes_near").cast("double"), total.cast("double")).alias("prop_fixes_near_resource"),
        F.try_divide(F.sum(F.col("mean_distance_m") * F.col("n_fixes")), F.sum(F.when(F.col("mean_distance_m").isNotNull(), F.col("n_fixes"))).cast("double")).alias("mean_resource_distance_m"), F.min("min_distance_m").alias("min_resource_distance_m"),
    )


def gps_epoch(
    df: DataFrame | None = None, epoch=_UNSET, epoch_mins: float | None = None, include: list[str] | None = None, groups: list[str] | None = None, movement: DataFrame | None = None, social: DataFrame | None = None, spatial: DataFrame | None = None,
    resource_use: DataFrame | None = None, thresholds_m: tuple[float, ...] = THRESHOLDS, herd_groups: list[str] | None = None, interpolate: bool = False, align_interval_mins: float | str = "base", min_fixes: int = 5, metric_crs: int | None = None, order_col: str = ORDER,
) -> DataFrame:
    """Metric blocks by epoch, computed from fixes or given as tables, merged into one.

    Movement and social blocks of the same fixes are aggregated together, in one grouping.
    """
    level, mins = resolve_epoch(epoch, epoch_mins)
    given = {"movement": movement, "social": social, "spatial": spatial, "resource_use": resource_use}
    chosen = include or [b for b in BLOCKS if given[b] is not None] or ["movement"]
    if bad := [b for b in chosen if b not in BLOCKS]:
        raise ValueError("unknown blocks: " + ", ".join(bad))
    tables = {}
    fresh = df is not None and movement is None and social is None and not interpolate and not {"total_distance_m", "mean_nearest_neighbour_m", "social_group_size"} & set(df.columns)
    if fresh and {"movement", "social"} <= set(chosen) and set(summary_groups(df, groups)) <= set(KEYS):
        rows = gps_social(df, thresholds_m, herd_groups, order_col=order_col)
        more = {"social_n_fixes": F.count(F.lit(1)), **social_metrics(sorted(set(thresholds_m)))}
        tables["movement"] = gps_movement_summary(rows, level, mins, summary_groups(df, groups), order_col, more, tuple(set(rows.columns) - set(df.columns)))
        chosen = [b for b in chosen if b not in ("movement", "social")]
    for block in [b for b in BLOCKS if b in chosen]:
        source = given[block] if given[block] is not None else df
        if source is None:
            raise ValueError(f"block {block} needs data")
        ready = set(EPOCH_COLUMNS) <= set(source.columns)
        if block == "movement":
            tables[block] = source if ready and "total_distance_m" in source.columns else gps_movement_summary(source, level, mins, summary_groups(source, groups), order_col)
        elif block == "social":
            tables[block] = source if ready and "mean_nearest_neighbour_m" in source.columns else gps_social_summary(source, level, mins, groups, thresholds_m, herd_groups, interpolate, align_interval_mins, order_col)
        elif block == "spatial":
            tables[block] = source if ready and "centroid_lon" in source.columns else gps_spatial(source, level, mins, groups, min_fixes, metric_crs)
        else:
            tables[block] = source if ready and "n_resources" in source.columns else resource_roll_up(source, groups)
    return merge_metric_tables(tables)


def gps_animal_summary(df: DataFrame, epoch=_UNSET, epoch_mins: float | None = None, include: list[str] | None = None, groups: list[str] | None = None, **options) -> DataFrame:
    """Metric blocks by animal and epoch."""
    return gps_epoch(df, epoch, epoch_mins, include, groups if groups is not None else summary_groups(df), **options)


def gps_group_summary(df: DataFrame, epoch=_UNSET, epoch_mins: float | None = None, group_cols: list[str] | None = None, include: list[str] | None = None, groups: list[str] | None = None, **options) -> DataFrame:
    """Animal summaries rolled up by herd: sums, and unweighted means of animal epochs."""
    herd = group_cols if group_cols is not None else [c for c in ("deployment_id", "herd_id", "group_id", "paddock", "treatment") if c in df.columns]
    require(df, *herd)
    keyed = list(dict.fromkeys([*(groups if groups is not None else summary_groups(df)), *herd]))
    rows = gps_animal_summary(df, epoch, epoch_mins, include, keyed, **options)
    has = lambda c: c in rows.columns
    metrics = [F.count(F.lit(1)).alias("n_animal_epochs")]
    metrics += [F.countDistinct(c).alias(n) for c, n in (("animal_id", "n_animals"), ("sensor_id", "n_sensors")) if has(c)]
    metrics += [F.sum(c).alias(c) for c in ("n_fixes", "total_distance_m") if has(c)]
    metrics += [F.avg("total_distance_m").alias("mean_total_distance_m")] if has("total_distance_m") else []
    metrics += [F.avg(c).alias(c) for c in rows.columns if c in ("mean_speed_mps", "mean_nearest_neighbour_m", "prop_fixes_near_resource") or c.startswith("prop_any_neighbour_within_")]
    return rows.groupBy(*herd, *EPOCH_COLUMNS).agg(*metrics)


def gps_diurnal(df: DataFrame, include: list[str] | None = None, groups: list[str] | None = None, **options) -> DataFrame:
    """Hourly animal summaries with ``date`` and ``hour``."""
    out = gps_animal_summary(df, "hour", None, include, groups, **options)
    return out.withColumns({"date": utc_date(F.unix_micros("epoch_start")), "hour": F.pmod(F.floor(F.unix_micros("epoch_start") / 3_600_000_000), F.lit(24)).cast("int")})
