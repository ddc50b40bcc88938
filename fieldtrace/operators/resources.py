"""Distance to resources, use of resources, visits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.epochs import _UNSET, EPOCH_COLUMNS, resolve_epoch, with_epochs
from fieldtrace.functions.shapes import Shape, distance
from fieldtrace.operators.layer_index import LayerTable, with_nearest
from fieldtrace.operators.spatial import checked, metric_crs, project, project_point
from fieldtrace.operators.tracks import ORDER, numbered, summary_groups, with_order


@dataclass(frozen=True)
class Resource:
    """A named place: one vertex is a point, an open path a line, with ``polygon`` an area (lon, lat vertices); or any ``shape``."""

    resource_id: str
    vertices: tuple[tuple[float, float], ...]
    resource_type: str | None = None
    polygon: bool = False
    shape: Shape | None = None

    def geometry(self) -> Shape:
        return self.shape or Shape("polygon" if self.polygon else "line" if len(self.vertices) > 1 else "point", ((tuple(self.vertices),),))


def _distances(df: DataFrame, resources: list[Resource], crs: int) -> Column:
    """One array of (distance, order, id, type): the layer is part of the plan, so nothing is joined or multiplied."""
    x, y = project(F.col("lon"), F.col("lat"), crs)
    found = []
    for k, r in enumerate(resources):
        d = distance(x, y, r.geometry().moved(lambda lon, lat: project_point(lon, lat, crs)))
        found.append(F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(r.resource_id).alias("id"), F.lit(r.resource_type).cast("string").alias("type")))
    return F.array(*found)


def gps_resource_distance(df: DataFrame, resources: list[Resource] | LayerTable, metric_crs: int | None = None) -> DataFrame:
    """The nearest resource of each fix and its distance in metres, 0 inside an area; ties go to the first.

    A list becomes part of the plan; a table of resources, of any size, is searched through rings of cells.
    """
    df = checked(df)
    if isinstance(resources, LayerTable):
        crs = _crs(df, metric_crs)
        near = with_nearest(df, *project(F.col("lon"), F.col("lat"), crs), resources, crs)
        return near.withColumns({"nearest_resource_id": F.col("_name"), "resource_distance_m": F.col("_d"), "nearest_resource_type": F.col("_kind"), "metric_crs": F.lit(f"EPSG:{crs}")}).drop("_no", "_name", "_kind", "_d")
    if not resources:
        return df.withColumns({"nearest_resource_id": F.lit(None).cast("string"), "resource_distance_m": F.lit(None).cast("double"), "nearest_resource_type": F.lit(None).cast("string"), "metric_crs": F.lit(None).cast("string")})
    crs = _crs(df, metric_crs)
    near = df.withColumn("_n", F.array_min(_distances(df, resources, crs)))
    return near.withColumns({"nearest_resource_id": F.col("_n.id"), "resource_distance_m": F.col("_n.d"), "nearest_resource_type": F.col("_n.type"), "metric_crs": F.lit(f"EPSG:{crs}")}).drop("_n")


_crs = metric_crs


def gps_resource_use(df: DataFrame, resources: list[Resource], radius_m: float = 25, epoch=_UNSET, epoch_mins: float | None = None, groups: list[str] | None = None, metric_crs: int | None = None) -> DataFrame:
    """Fixes within a radius of each resource, by group and epoch; shares are of all fixes of the epoch."""
    if radius_m < 0:
        raise ValueError("radius_m must not be negative")
    level, mins = resolve_epoch(epoch, epoch_mins)
    df = checked(df)
    crs = _crs(df, metric_crs)
    by = [*summary_groups(df, groups), *EPOCH_COLUMNS]
    at = with_epochs(df, level, mins).withColumn("_r", F.explode(_distances(df, resources, crs)))
    d = F.col("_r.d")
    out = at.groupBy(*by, F.col("_r.id").alias("resource_id"), F.col("_r.type").alias("resource_type")).agg(
        F.count(F.lit(1)).alias("n_fixes"), F.sum((d <= radius_m).cast("long")).alias("n_fixes_near"), F.avg(d).alias("mean_distance_m"), F.percentile(d, F.lit(0.5)).alias("median_distance_m"), F.min(d).alias("min_distance_m")
    )
    return out.withColumns({"n_total_fixes": F.col("n_fixes"), "prop_fixes_near": F.col("n_fixes_near") / F.col("n_fixes"), "radius_m": F.lit(float(radius_m)), "metric_crs": F.lit(f"EPSG:{crs}")})


def gps_resource_visits(
    df: DataFrame, resources: list[Resource] | LayerTable, radius_m: float = 25, max_gap_mins: float = 30, min_fixes: int = 1, min_duration_mins: float = 0, groups: list[str] | None = None, metric_crs: int | None = None, order_col: str = ORDER,
) -> DataFrame:
    """Bouts near the nearest resource: one begins where the last fix was not near, near another, or too long ago.

    ``visit_id`` numbers the visits of all groups in one sequence, by group and time.
    """
    df = with_order(gps_resource_distance(df, resources, metric_crs), order_col)
    grp = summary_groups(df, groups)
    w = Window.partitionBy(*grp).orderBy("datetime", order_col)
    near = F.col("resource_distance_m") <= radius_m
    gap = (F.unix_micros("datetime") - F.unix_micros(F.lag("datetime").over(w))) / 60e6
    rows = df.withColumn("_near", near).withColumns({"_starts": F.col("_near") & ~F.coalesce(F.lag("_near").over(w) & (F.lag("nearest_resource_id").over(w) == F.col("nearest_resource_id")) & (gap <= max_gap_mins), F.lit(False))})
    rows = rows.withColumn("_visit", F.sum(F.col("_starts").cast("int")).over(w)).filter("_near")
    out = rows.groupBy(*grp, "_visit", F.col("nearest_resource_id").alias("resource_id")).agg(
        F.first("nearest_resource_type").alias("resource_type"), F.min("datetime").alias("visit_start"), F.max("datetime").alias("visit_end"), F.count(F.lit(1)).alias("n_fixes"), F.min("resource_distance_m").alias("min_distance_m"), F.avg("resource_distance_m").alias("mean_distance_m"), F.first("metric_crs").alias("metric_crs"),
    )
    out = out.withColumns({"duration_mins": (F.unix_micros("visit_end") - F.unix_micros("visit_start")) / 60e6, "radius_m": F.lit(float(radius_m))}).filter((F.col("n_fixes") >= min_fixes) & (F.col("duration_mins") >= min_duration_mins))
    return numbered(out, grp, ["_visit"], "visit_id").drop("_visit")
