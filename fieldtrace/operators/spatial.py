"""Home ranges: minimum convex polygons, kernel density, bounds, hotspots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geo
from fieldtrace.functions.epochs import _UNSET, EPOCH_COLUMNS, resolve_epoch, with_epochs
from fieldtrace.operators.tracks import join_by, prepare, summary_groups


#: The most points of a group that meet in one part of its hull.
PART_POINTS = 50_000


def metric_crs(df: DataFrame, crs: int | None = None) -> int:
    """The EPSG code of the metric grid: as given (3857, 326xx, 327xx), or the UTM zone of the mean fix.

    Finding the zone reads the table once; 3857 where no fix has coordinates.
    """
    if crs is not None:
        if crs != 3857 and not (32601 <= crs <= 32660 or 32701 <= crs <= 32760):
            raise ValueError(f"EPSG:{crs} is not supported")
        return crs
    lon, lat = df.agg(F.avg(geo.finite(F.col("lon"))), F.avg(geo.finite(F.col("lat")))).first()
    if lon is None or lat is None:
        return 3857
    return (32600 if lat >= 0 else 32700) + min(max(int((lon + 180) // 6) + 1, 1), 60)


def project(lon: Column, lat: Column, crs: int) -> tuple[Column, Column]:
    return geo.web_mercator(lon, lat) if crs == 3857 else geo.utm(lon, lat, F.lit(crs % 100), F.lit(crs < 32700))


def unproject(x: Column, y: Column, crs: int) -> tuple[Column, Column]:
    if crs == 3857:
        return F.degrees(x / geo.WGS84_A), F.degrees(2 * F.atan(F.exp(y / geo.WGS84_A)) - np.pi / 2)
    return geo.utm_inverse(x, y, F.lit(crs % 100), F.lit(crs < 32700))


def project_point(lon: float, lat: float, crs: int) -> tuple[float, float]:
    return geo.mercator_point(lon, lat) if crs == 3857 else geo.utm_point(lon, lat, crs % 100, crs < 32700)


def checked(df: DataFrame) -> DataFrame:
    """The typed table; reading a row with an invalid time or coordinate is an error."""
    df = prepare(df)
    ok = geo.valid_coordinate(F.col("lon"), F.col("lat")) & F.col("datetime").isNotNull()
    return df.withColumn("lon", F.when(ok, F.col("lon")).otherwise(F.raise_error(F.lit("invalid time or coordinate")).cast("double")))


def _points(df: DataFrame, level: str, mins: float | None, groups: list[str] | None, crs: int | None) -> tuple[DataFrame, list[str], int]:
    df = checked(df)
    crs = metric_crs(df, crs)
    x, y = project(F.col("lon"), F.col("lat"), crs)
    grp = summary_groups(df, groups)
    return with_epochs(df, level, mins).withColumns({"_x": x, "_y": y}), [*grp, *EPOCH_COLUMNS], crs


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain); under three corners where points lie on a line."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    pts = points[order]
    # Of the points at one x only the lowest and the highest can be corners.
    new = np.append(True, pts[1:, 0] != pts[:-1, 0])[: len(pts)]
    pts = pts[new | np.append(new[1:], True)[: len(pts)]]
    pts = pts[np.append(True, (pts[1:] != pts[:-1]).any(1))[: len(pts)]]
    if len(pts) < 3:
        return pts

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])


def _area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def _hulled(df: DataFrame) -> DataFrame:
    """Reduce ``_points`` of each row to the corners of their hull, and add ``_area``."""
    at = df.columns.index("_points")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(at)
            flat, ends = points.flatten(), np.cumsum([0, *pc.list_value_length(points).to_pylist()])
            xy = np.column_stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()])
            rings = [hull(xy[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            corners = np.concatenate([np.empty((0, 2)), *(r.reshape(-1, 2) for r in rings)])
            made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], ["_x", "_y"]))
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(b.columns)] + [pa.array([_area(r) for r in rings], pa.float64())], [*b.schema.names, "_area"])

    return df.drop("_area").mapInArrow(reduced, _schema(df, df.columns) + ", _area double")


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def gps_mcp(df: DataFrame, percent: tuple[float, ...] = (100, 95), epoch=_UNSET, epoch_mins: float | None = None, groups: list[str] | None = None, min_fixes: int = 5, metric_crs: int | None = None, return_geometry: bool = False) -> DataFrame:
    """Area in hectares of the hull of the fixes, or of the share nearest to their mean centre.

    Distances and cuts are windows and exact percentiles.
    """
    level, mins = resolve_epoch(epoch, epoch_mins)
    pts, by, crs = _points(df, level, mins, groups, metric_crs)
    w = Window.partitionBy(*by)
    pts = pts.withColumns({"n_fixes": F.count(F.lit(1)).over(w), "_d": F.hypot(F.col("_x") - F.avg("_x").over(w), F.col("_y") - F.avg("_y").over(w))})
    pts = pts.withColumn("_cut", F.percentile("_d", F.array(*[F.lit(p / 100) for p in percent])).over(w))
    pts = pts.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percent])))
    cut = F.element_at(F.map_from_arrays(F.array(*[F.lit(float(p)) for p in percent]), F.col("_cut")), F.col("percent"))
    kept = pts.filter((F.col("percent") >= 100) | (F.col("_d") <= cut))
    key = [*by, "percent", "n_fixes"]
    # The hull of a group is the hull of its parts' hulls, so no task holds more points than a part has.
    part = F.pmod(F.xxhash64("_x", "_y"), F.ceil(F.col("n_fixes") / PART_POINTS))
    parts = kept.groupBy(*key, part.alias("_part")).agg(F.collect_set(F.struct("_x", "_y")).alias("_points"))
    parts = _hulled(parts.withColumn("_used", F.size("_points").cast("long")))
    whole = _hulled(parts.groupBy(*key).agg(F.flatten(F.collect_list("_points")).alias("_points"), F.sum("_used").alias("n_fixes_used")))
    area = F.when((F.col("n_fixes") >= max(3, min_fixes)) & (F.col("n_fixes_used") >= 3) & (F.col("_area") > 0), F.col("_area") / 1e4)
    ring = F.transform("_points", lambda p: F.array(p["_x"], p["_y"]))
    out = whole.withColumn("area_ha", area).withColumn("ring", F.when(F.col("area_ha").isNotNull(), ring)).drop("_points", "_area").withColumn("metric_crs", F.lit(f"EPSG:{crs}"))
    if not return_geometry:
        return out.drop("ring")
    lon, lat = (lambda p: unproject(p[0], p[1], crs)[0]), (lambda p: unproject(p[0], p[1], crs)[1])
    return out.withColumn("geometry", F.transform("ring", lambda p: F.array(lon(p), lat(p)))).drop("ring")


def _grids(pts: DataFrame, by: list[str], band: tuple[float, float] | None, cell_size_m: float | None, max_cells: int) -> DataFrame:
    """By group: bandwidths ``_bx, _by``, the cell size ``_c``, the first centres ``_gx, _gy`` and how many ``_nx, _ny``.

    The bandwidth of an axis is the usual rule of thumb, at least a metre; a grid reaches three bandwidths beyond the
    points, and its cells grow until there are about ``max_cells`` at most.
    """
    moments = [f(F.col(f"_{v}")).alias(f"{a}_{v}") for v in "xy" for a, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))]
    quarters = [F.percentile(f"_{v}", F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{v}") for v in "xy"]
    g = pts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fixes"), *moments, *quarters)
    sd = lambda v: F.coalesce(geo.finite(F.col(f"sd_{v}")), F.lit(0.0))
    low = lambda v: F.coalesce(F.nullif(F.least(sd(v), (F.col(f"q_{v}")[1] - F.col(f"q_{v}")[0]) / 1.34), F.lit(0.0)), F.nullif(sd(v), F.lit(0.0)), F.nullif(F.abs(f"lo_{v}"), F.lit(0.0)), F.lit(1.0))
    rule = lambda v: F.greatest(0.9 * low(v) * F.pow(F.col("n_fixes").cast("double"), F.lit(-0.2)), F.lit(1.0))
    g = g.withColumns({f"_b{v}": F.lit(float(band[k])) if band else rule(v) for k, v in enumerate("xy")})
    g = g.withColumn("_c", F.lit(float(cell_size_m)) if cell_size_m else F.greatest(F.lit(1.0), F.least("_bx", "_by") / 2))
    size = lambda v: F.floor((F.col(f"hi_{v}") - F.col(f"lo_{v}") + 6 * F.col(f"_b{v}")) / F.col("_c") + 1e-9) + 1
    g = g.withColumn("_c", F.when(size("x") * size("y") > max_cells, F.col("_c") * F.sqrt(size("x") * size("y") / F.lit(max_cells))).otherwise(F.col("_c")))
    return g.select(*by, "n_fixes", "_bx", "_by", "_c", *[(F.col(f"lo_{v}") - 3 * F.col(f"_b{v}")).alias(f"_g{v}") for v in "xy"], *[size(v).cast("int").alias(f"_n{v}") for v in "xy"])


def _kernel_sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a grid and the sums of the product Gaussian kernel over the points of a part."""
    one = {c: table.column(c)[0].as_py() for c in ("_bx", "_by", "_c", "_gx", "_gy", "_nx", "_ny")}
    z = np.zeros((one["_nx"], one["_ny"]))
    for k in range(0, table.num_rows, 4096):
        away = [np.arange(one[f"_n{v}"])[:, None] * one["_c"] + one[f"_g{v}"] - table.column(f"_{v}").slice(k, 4096).to_numpy()[None] for v in "xy"]
        ex, ey = (np.exp(-0.5 * (d / one[f"_b{v}"]) ** 2) / (one[f"_b{v}"] * np.sqrt(2 * np.pi)) for v, d in zip("xy", away, strict=True))
        z += ex @ ey.T
    return np.repeat(np.arange(one["_nx"]), one["_ny"]), np.tile(np.arange(one["_ny"]), one["_nx"]), z.reshape(-1)


def gps_kde(
    df: DataFrame, bandwidth_m: float | tuple[float, float] | None = None, cell_size_m: float | None = None, percent: tuple[float, ...] = (95, 50), keep_all: bool = False, max_cells: int = 10000, epoch=_UNSET, epoch_mins: float | None = None,
    groups: list[str] | None = None, min_fixes: int = 5, metric_crs: int | None = None, return_geometry: bool = False,
) -> DataFrame:
    """Kernel density cells by group and epoch, with flags for the cells that make up each percentage of use.

    The density is exact. A group of at most PART_POINTS points becomes its result inside one task, so its grid is never shuffled.
    A part of a larger group gives one sum a cell, and sums of parts add up: no task holds more points of a group, nor more cells than a grid has.
    """
    level, mins = resolve_epoch(epoch, epoch_mins)
    pts, by, crs = _points(df, level, mins, groups, metric_crs)
    band = (float(bandwidth_m),) * 2 if isinstance(bandwidth_m, (int, float)) else bandwidth_m
    grids = _grids(pts, by, band, cell_size_m, max_cells).filter(F.col("n_fixes") >= min_fixes)
    own, grid = [f"_k{i}" for i in range(len(by))], ["n_fixes", "_bx", "_by", "_c", "_gx", "_gy"]
    share = None if keep_all else max(percent) / 100
    # Groups go by names of their own: a column of the result may be called as one of them.
    rows = join_by(pts.select(*by, "_x", "_y", "datetime"), grids, by).withColumn("_parts", F.ceil(F.col("n_fixes") / PART_POINTS)).withColumnsRenamed(dict(zip(by, own, strict=True)))

    def same(table: pa.Table, columns: list[str], n: int) -> dict[str, pa.Array]:
        return {k: pa.chunked_array([pa.repeat(table.column(k)[0], n)]) for k in columns}

    def ranked(table: pa.Table, ix: np.ndarray, iy: np.ndarray, z: np.ndarray) -> pa.Table:
        """The cells of a grid in order of use, with their shares; those beyond the largest percentage go."""
        n, c, gx, gy = (table.column(k)[0].as_py() for k in ("n_fixes", "_c", "_gx", "_gy"))
        x, y, density = ix * c + gx, iy * c + gy, z / n
        total = density.sum()
        order = np.lexsort((y, x, -density)) if total > 0 else np.zeros(0, np.int64)
        probability = density[order] / total
        cumulative = np.cumsum(probability)
        if share is not None:
            kept = cumulative - probability < share
            order, probability, cumulative = order[kept], probability[kept], cumulative[kept]
            rank = np.flatnonzero(kept) + 1
        else:
            rank = np.arange(len(order)) + 1
        values = {"density_rank": rank, "cell_centre_x": x[order], "cell_centre_y": y[order], "kde_density": density[order], "cell_probability": probability, "cumulative_probability": cumulative}
        return pa.table({**same(table, [*own, *grid], len(order)), **{k: pa.array(v) for k, v in values.items()}})

    def whole(table: pa.Table) -> pa.Table:
        return ranked(table, *_kernel_sums(table))

    def sums(table: pa.Table) -> pa.Table:
        ix, iy, z = _kernel_sums(table)
        return pa.table({**same(table, [*own, *grid], len(z)), "_ix": pa.array(ix.astype(np.int32)), "_iy": pa.array(iy.astype(np.int32)), "_z": pa.array(z)})

    def added(table: pa.Table) -> pa.Table:
        return ranked(table, *(table.column(k).to_numpy() for k in ("_ix", "_iy", "_z")))

    kinds = _schema(rows, [*own, *grid])
    shape = f"{kinds}, density_rank long, cell_centre_x double, cell_centre_y double, kde_density double, cell_probability double, cumulative_probability double"
    part = F.pmod(F.xxhash64("_x", "_y", "datetime"), F.col("_parts"))
    few = rows.filter("_parts = 1").groupBy(*own).applyInArrow(whole, shape)
    parts = rows.filter("_parts > 1").withColumn("_part", part).groupBy(*own, "_part").applyInArrow(sums, f"{kinds}, _ix int, _iy int, _z double")
    many = parts.groupBy(*own, *grid, "_ix", "_iy").agg(F.sum("_z").alias("_z")).groupBy(*own).applyInArrow(added, shape)
    out = few.unionByName(many).withColumnsRenamed(dict(zip(own, by, strict=True)))
    out = out.select(*by, "n_fixes", "density_rank", "cell_centre_x", "cell_centre_y", "kde_density", "cell_probability", "cumulative_probability", F.col("_bx").alias("bandwidth_x_m"), F.col("_by").alias("bandwidth_y_m"), F.col("_c").alias("cell_size_m"))
    before = F.col("cumulative_probability") - F.col("cell_probability")
    out = out.withColumns({f"in_kde{p:g}": before < p / 100 for p in percent})
    lon, lat = unproject(F.col("cell_centre_x"), F.col("cell_centre_y"), crs)
    out = out.withColumns({"cell_centre_lon": lon, "cell_centre_lat": lat, "metric_crs": F.lit(f"EPSG:{crs}")})
    if return_geometry:
        h = F.col("cell_size_m") / 2
        corner = lambda sx, sy: F.array(*unproject(F.col("cell_centre_x") + sx * h, F.col("cell_centre_y") + sy * h, crs))
        out = out.withColumn("geometry", F.array(*[corner(*s) for s in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]))
    return out


def gps_hotspots(df: DataFrame, cell_size_m: float = 50, hotspot_quantile: float = 0.9, keep_all: bool = False, epoch=_UNSET, epoch_mins: float | None = None, groups: list[str] | None = None, metric_crs: int | None = None) -> DataFrame:
    """Grid cells whose counts reach a quantile of the counts of their group and epoch."""
    if not cell_size_m > 0 or not 0 <= hotspot_quantile <= 1:
        raise ValueError("cell_size_m must be positive, hotspot_quantile between 0 and 1")
    level, mins = resolve_epoch(epoch, epoch_mins)
    pts, by, crs = _points(df, level, mins, groups, metric_crs)
    cells = pts.withColumns({"cell_x": F.floor(F.col("_x") / cell_size_m).cast("double"), "cell_y": F.floor(F.col("_y") / cell_size_m).cast("double")}).groupBy(*by, "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n_fixes"))
    w = Window.partitionBy(*by)
    out = cells.withColumns({"total_fixes": F.sum("n_fixes").over(w), "hotspot_count_threshold": F.percentile("n_fixes", F.lit(hotspot_quantile)).over(w), "cell_centre_x": (F.col("cell_x") + 0.5) * cell_size_m, "cell_centre_y": (F.col("cell_y") + 0.5) * cell_size_m})
    out = out.withColumns({"prop_fixes": F.col("n_fixes") / F.col("total_fixes"), "is_hotspot": F.col("n_fixes") >= F.col("hotspot_count_threshold")})
    lon, lat = unproject(F.col("cell_centre_x"), F.col("cell_centre_y"), crs)
    out = out.withColumns({"cell_centre_lon": lon, "cell_centre_lat": lat, "metric_crs": F.lit(f"EPSG:{crs}")})
    return out if keep_all else out.filter("is_hotspot")


def gps_spatial(df: DataFrame, epoch=_UNSET, epoch_mins: float | None = None, groups: list[str] | None = None, min_fixes: int = 5, metric_crs: int | None = None) -> DataFrame:
    """Bounds, centroid, span, and hull areas of all fixes and of the nearest 95 %, by group and epoch."""
    level, mins = resolve_epoch(epoch, epoch_mins)
    pts, by, crs = _points(df, level, mins, groups, metric_crs)
    basic = pts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_fixes"), F.min("datetime").alias("start_datetime"), F.max("datetime").alias("end_datetime"), ((F.unix_micros(F.max("datetime")) - F.unix_micros(F.min("datetime"))) / 3.6e9).alias("span_hours"),
        *[f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))], F.avg("lon").alias("centroid_lon"), F.avg("lat").alias("centroid_lat"),
    )
    mcp = gps_mcp(df, (100, 95), level, mins, groups, min_fixes, crs)
    wide = mcp.groupBy(*by).agg(*[F.max(F.when(F.col("percent") == p, F.col("area_ha"))).alias(f"mcp{p}_area_ha") for p in (100, 95)])
    keys = [F.col(f"b.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    joined = basic.alias("b").join(wide.alias("m"), keys, "left")
    return joined.select("b.*", "m.mcp100_area_ha", "m.mcp95_area_ha", F.lit(f"EPSG:{crs}").alias("metric_crs"))
