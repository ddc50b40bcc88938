"""Map and playback features as tables, and writers of GeoJSON and self-contained HTML."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import stats
from fieldtrace.functions.epochs import utc_text
from fieldtrace.functions.geo import valid_coordinate
from fieldtrace.functions.shapes import shape_fault
from fieldtrace.operators.alignment import gps_interpolate
from fieldtrace.operators.layer_index import LayerTable
from fieldtrace.operators.tracks import ORDER, blank, prepare, with_order

#: Colours of states.
STATE_COLORS = {"inactive": "#d7191c", "active": "#1a9641"}
MISSING_COLOR = "#808080"


def map_groups(df: DataFrame, groups: list[str] | None = None) -> list[str]:
    return list(groups) if groups else [c for c in ("sensor_id", "animal_id", "device_id", "deployment_id") if c in df.columns][:1]


def group_label(groups: list[str]) -> Column:
    return F.concat_ws(" | ", *[F.when(blank(F.col(c)), "(missing)").otherwise(F.col(c).cast("string")) for c in groups])


def popup(fields: list[str]) -> Column:
    """Popup text, one line per field, markup escaped."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(*[F.concat(F.lit(f"<b>{c}:</b> "), safe(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("<br/>")) for c in fields])


def state_color(state_col: str | None, colors: dict[str, str] | None = None) -> Column:
    if state_col is None:
        return F.lit(None).cast("string")
    out, state = None, F.lower(F.trim(F.col(state_col).cast("string")))
    for name, color in (colors or STATE_COLORS).items():
        out = F.when(state == name, color) if out is None else out.when(state == name, color)
    return out.otherwise(MISSING_COLOR)


def _pick(df: DataFrame, label: str, max_groups: int | None, max_points: int | None, by_group: bool, seed: int, order_col: str) -> DataFrame:
    """Whole groups, then points, by seeded hash; by group, small groups leave their share to the others."""
    if max_groups is not None:
        chosen = df.select(label).distinct().orderBy(F.xxhash64(F.lit(seed), label), label).limit(max_groups)
        df = df.join(chosen, label, "left_semi")
    if max_points is None:
        return df
    draw = F.xxhash64(F.lit(seed + 1), order_col)
    if not by_group:
        return df.orderBy(draw, order_col).limit(max_points)
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(label).orderBy(draw, order_col)))
    return ranked.orderBy("_turn", draw, order_col).limit(max_points).drop("_turn")


def gps_map(
    df: DataFrame, groups: list[str] | None = None, state_col: str | None = None, state_colors: dict[str, str] | None = None, popup_fields: tuple[str, ...] = ("sensor_id", "datetime"), max_points: int | None = None, max_groups: int | None = None, seed: int = 1, order_col: str = ORDER,
) -> DataFrame:
    """The points of a map: group label, colour of the state, popup, in time order within a group (``seq``)."""
    df = with_order(prepare(df), order_col).filter(valid_coordinate(F.col("lon"), F.col("lat")) & F.col("datetime").isNotNull())
    out = df.withColumn("map_group", group_label(map_groups(df, groups)))
    out = _pick(out, "map_group", max_groups, max_points, True, seed, order_col)
    w = Window.partitionBy("map_group").orderBy("datetime", order_col)
    return out.select("map_group", F.row_number().over(w).alias("seq"), order_col, "datetime", "lon", "lat", state_color(state_col, state_colors).alias("color"), popup(list(popup_fields)).alias("popup"))


def gps_playback(
    df: DataFrame, groups: list[str] | None = None, state_col: str | None = None, state_colors: dict[str, str] | None = None, align: bool = True, align_interval_mins: float | str = "base", tail_points: int = 19, tail_minutes: float | None = None, popup_fields: tuple[str, ...] = ("sensor_id", "datetime"),
    max_groups: int | None = None, max_rows: int | None = None, render_every_n: int = 1, seed: int = 1, smooth_movement: bool = True, order_col: str = ORDER,
) -> tuple[DataFrame, DataFrame]:
    """Points with the time they show, and tail lines between consecutive points with the time they last.

    A point shows until the next one of its group, and at least for the median step; a line until ``tail_minutes``, or
    ``tail_points`` median steps, after the arrival at its end, from that arrival on or, with ``smooth_movement``, from the
    departure at its start on. Points carry where the next one is, lines when their movement starts and ends.
    """
    df = with_order(prepare(df), order_col)
    grp = map_groups(df, groups)
    if align:
        df = gps_interpolate(df, align_interval_mins, grp, True, order_col)
        df = df.withColumn(order_col, F.xxhash64(*grp, *[c for c in ["segment_id"] if c in df.columns], "datetime"))
    pts = df.filter(valid_coordinate(F.col("lon"), F.col("lat")) & F.col("datetime").isNotNull()).withColumn("map_group", group_label(grp))
    pts = _pick(pts, "map_group", max_groups, max_rows, True, seed, order_col)
    w = Window.partitionBy("map_group").orderBy("datetime", order_col)
    pts = pts.withColumn("seq", F.row_number().over(w)).filter(F.pmod(F.col("seq") - 1, F.lit(render_every_n)) == 0)
    ahead = {"_t": F.lead("datetime").over(w), "_lon": F.lead("lon").over(w), "_lat": F.lead("lat").over(w)}
    pts = pts.withColumns(ahead).withColumn("_gap", F.unix_micros("_t") - F.unix_micros("datetime"))
    step = F.broadcast(stats.quantiles(stats.counted(pts.filter("_gap > 0"), F.col("_gap").cast("double")), {"g": 0.5}).select(F.coalesce("g", F.lit(60e6)).cast("long").alias("_step")))
    pts = pts.join(step)
    start = F.unix_micros("datetime")
    points = pts.select("map_group", "seq", "lon", "lat", F.col("datetime").alias("start_time"), F.timestamp_micros(F.greatest(F.coalesce(F.unix_micros("_t"), start), start + F.col("_step"))).alias("end_time"), state_color(state_col, state_colors).alias("color"), popup([c for c in popup_fields if c in pts.columns]).alias("popup"), F.col("_lon").alias("next_lon"), F.col("_lat").alias("next_lat"))
    tail = F.lit(int(tail_minutes * 60e6)) if tail_minutes is not None else F.col("_step") * tail_points
    tails = pts.filter("_t is not null").select("map_group", "seq", F.array(F.array("lon", "lat"), F.array("_lon", "_lat")).alias("line"), F.col("datetime" if smooth_movement else "_t").alias("start_time"), F.timestamp_micros(F.unix_micros("_t") + tail.cast("long")).alias("end_time"), state_color(state_col, state_colors).alias("color"), F.col("datetime").alias("movement_start"), F.col("_t").alias("movement_end"))
    return points, tails


def map_size(points: DataFrame, point_warning_n: int = 5000, group_warning_n: int = 20) -> DataFrame:
    """One row: how many points and groups a map has, and whether either is more than a browser shows well."""
    n = points.agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("map_group").alias("n_groups"))
    return n.withColumns({"many_points": F.col("n_points") > point_warning_n, "many_groups": F.col("n_groups") > group_warning_n})


def timeline_points(points: DataFrame) -> DataFrame:
    """Points of ``gps_map`` with the time they appear at, in milliseconds since the Unix epoch and as text, by time."""
    ms = F.floor(F.unix_micros("datetime") / 1000)
    return points.withColumns({"time_ms": ms, "time": F.concat(F.replace(utc_text(F.unix_micros("datetime")), F.lit(" "), F.lit("T")), F.lit("Z")), "layer_id": F.concat_ws("-", "map_group", F.col("seq").cast("string"))})


def map_polygons(
    layer: LayerTable, label: bool = True, polygon_group: str = "Polygons", color: str = "#03F", weight: float = 5, opacity: float = 0.5, fill: bool = True, fill_opacity: float = 0.2,
) -> DataFrame:
    """Polygons of a map: ``map_group, layer_no, label, geometry`` (GeoJSON in degrees) and their style.

    Reading the table fails where a geometry is no polygon, empty or invalid: a ring with under three different vertices,
    without area or crossing itself, a hole outside its polygon.
    """
    if not polygon_group.strip() or not color.strip():
        raise ValueError("polygon_group and color must not be blank")
    if weight < 0 or not 0 <= opacity <= 1 or not 0 <= fill_opacity <= 1:
        raise ValueError("weight must not be negative, opacities between 0 and 1")
    read = layer.shapes(4326)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, name, _, shape in read(batches):
            if fault := shape_fault(shape):
                raise ValueError(f"feature {no} of the layer is {fault}")
            closed = [[[*map(list, ring), list(ring[0])] if ring[0] != ring[-1] else list(map(list, ring)) for ring in part] for part in shape.parts]
            geometry = {"type": "MultiPolygon", "coordinates": closed} if len(closed) > 1 else {"type": "Polygon", "coordinates": closed[0]}
            yield pa.RecordBatch.from_pydict({"layer_no": pa.array([no], pa.int64()), "label": pa.array([name], pa.string()), "geometry": [json.dumps(geometry)]})

    out = layer.df.mapInArrow(checked, "layer_no long, label string, geometry string")
    style = {"color": F.lit(color), "weight": F.lit(float(weight)), "opacity": F.lit(float(opacity)), "fill": F.lit(fill), "fill_opacity": F.lit(float(fill_opacity))}
    return out.select(F.lit(polygon_group).alias("map_group"), "layer_no", (F.col("label") if label else F.lit(None).cast("string")).alias("label"), "geometry", *[c.alias(n) for n, c in style.items()])


def polygon_features(polygons: DataFrame) -> DataFrame:
    """One GeoJSON feature per polygon, as text."""
    own = F.to_json(F.struct(*[c for c in polygons.columns if c != "geometry"]))
    return polygons.select("map_group", F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"), F.lit(',"properties":'), own, F.lit("}")).alias("value"))


def write_collections(grouped: DataFrame, path: str) -> None:
    """One GeoJSON FeatureCollection a group, in folders ``map_group=...`` under ``path``: rows are ``map_group, value``.

    A collection's lines are written one after another by one task, in the order of ``order`` where the table has it; no
    group is held in memory.
    """
    order = [c for c in ("order",) if c in grouped.columns]
    first = F.row_number().over(Window.partitionBy("map_group").orderBy(*(order or ["value"]))) == 1
    lines = grouped.withColumn("_line", F.when(first, F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    lines = lines.select("map_group", F.lit(1).alias("_part"), F.col("_line").alias("value"), F.when(first, 0).otherwise(1).alias("_head"), *order)
    frame = grouped.select("map_group").distinct().withColumn("_e", F.explode(F.array(F.struct(F.lit(0).alias("_part"), F.lit('{"type":"FeatureCollection","features":[').alias("value")), F.struct(F.lit(2).alias("_part"), F.lit("]}").alias("value")))))
    rows = lines.unionByName(frame.select("map_group", "_e.*"), allowMissingColumns=True).repartition("map_group").sortWithinPartitions("map_group", "_part", "_head", *order)
    rows.select("map_group", "value").write.mode("overwrite").partitionBy("map_group").text(path)


def write_playback(points: DataFrame, tails: DataFrame, path: str) -> None:
    """The lines and points of ``gps_playback``, a collection for each group: first its lines, then its points, in time."""
    ms = lambda df: df.withColumns({c: F.floor(F.unix_micros(c) / 1000) for c in df.columns if c.endswith("_time") or c.startswith("movement_")})
    tagged = lambda df, kind, k: features(ms(df), kind, ("map_group", "seq")).select("map_group", F.struct(F.lit(k).alias("kind"), "seq").alias("order"), "value")
    write_collections(tagged(tails, "LineString", 0).unionByName(tagged(points, "Point", 1)), path)


def features(df: DataFrame, kind: str = "Point", keep: tuple[str, ...] = ()) -> DataFrame:
    """One GeoJSON feature per row, as text, beside the columns to ``keep``."""
    where = F.array("lon", "lat") if kind == "Point" else F.col("line")
    own = [c for c in df.columns if c not in ("lon", "lat", "line")]
    return df.select(*keep, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), where.alias("coordinates")).alias("geometry"), F.struct(*own).alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str, kind: str = "Point") -> None:
    """Features as line-delimited GeoJSON, written by the executors."""
    features(df, kind).write.mode("overwrite").text(path)


def write_html(df: DataFrame, path: str, limit: int = 5000) -> None:
    """A small self-contained map of at most ``limit`` points; more are an error, as a page cannot hold them."""
    rows = df.select("map_group", "lon", "lat", "color").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} points: sample with max_points first")
    data = json.dumps([[r["map_group"], r["lon"], r["lat"], r["color"] or "#03f"] for r in rows])
    page = """<!doctype html><meta charset="utf-8"><canvas id="c" width="900" height="700"></canvas><script>
const p=%s,c=document.getElementById('c').getContext('2d');
const xs=p.map(r=>r[1]),ys=p.map(r=>r[2]),x0=Math.min(...xs),x1=Math.max(...xs),y0=Math.min(...ys),y1=Math.max(...ys);
for(const r of p){c.fillStyle=r[3];c.beginPath();c.arc(20+860*(r[1]-x0)/((x1-x0)||1),680-660*(r[2]-y0)/((y1-y0)||1),3,0,7);c.fill();}
</script>"""
    Path(path).write_text(page % data)
