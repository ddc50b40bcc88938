"""Spatial layers: GeoJSON files, tables with a geometry column, well-known text.

A small layer becomes part of a plan: it is read to the driver, and ``MAX_BYTES`` bounds what is. A layer of any size stays
a table (``paddock_table``, ``resource_table``) that fixes are joined with through a spatial index.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions.shapes import Shape, from_geojson, parse, to_degrees
from fieldtrace.operators.layer_index import LayerTable
from fieldtrace.operators.resources import Resource

#: The most text of geometries that a layer may have.
MAX_BYTES = 64_000_000
#: Columns that name a paddock, in this order.
NAME_COLUMNS = ("NAME", "Name", "name", "Description")


@dataclass(frozen=True)
class Feature:
    """A geometry in degrees and its columns."""

    shape: Shape
    properties: dict = field(default_factory=dict)


Layer = list[Feature]


def read_geojson(spark: SparkSession, path: str, crs: int = 4326) -> Layer:
    """Features of a GeoJSON file (a collection, a feature or a bare geometry); those without geometry are left out.

    A file that names its CRS as EPSG or CRS84 overrides ``crs``.
    """
    files = spark.read.text(path, wholetext=True)
    _bounded(files, "value")
    out: Layer = []
    for row in files.collect():
        data = json.loads(row["value"])
        named = str(((data.get("crs") or {}).get("properties") or {}).get("name", ""))
        own = 4326 if named.endswith("CRS84") else int(named.rsplit(":", 1)[1]) if "EPSG" in named else crs
        features = data["features"] if data.get("type") == "FeatureCollection" else [data] if data.get("type") == "Feature" else [{"geometry": data, "properties": {}}]
        out += [Feature(to_degrees(from_geojson(f["geometry"]), own), f.get("properties") or {}) for f in features if f.get("geometry")]
    return out


def layer_from_table(df: DataFrame, geometry_col: str = "geometry", crs: int = 4326) -> Layer:
    """Features of a table whose ``geometry_col`` holds well-known text or GeoJSON; null geometries are left out."""
    rows = df.filter(F.col(geometry_col).isNotNull())
    _bounded(rows, geometry_col)
    return [Feature(to_degrees(parse(r[geometry_col]), crs), {c: r[c] for c in df.columns if c != geometry_col}) for r in rows.collect()]


def _bounded(df: DataFrame, column: str) -> None:
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    if size > MAX_BYTES:
        raise ValueError(f"a layer of {size} bytes is too large: {MAX_BYTES} at most")


def paddocks(layer: Layer, name_col: str | None = None) -> list[tuple[str, Shape]]:
    """Names and polygons; without ``name_col`` the first of NAME_COLUMNS that names every feature."""
    if any(f.shape.kind != "polygon" for f in layer):
        raise ValueError("paddocks must be polygons")
    named = lambda c: all(f.properties.get(c) is not None and str(f.properties[c]).strip() for f in layer)
    if name_col is not None:
        if layer and not any(name_col in f.properties for f in layer):
            raise ValueError(f"no column {name_col!r}")
    else:
        name_col = next((c for c in NAME_COLUMNS if named(c)), None)
        if name_col is None:
            raise ValueError("no column of " + ", ".join(NAME_COLUMNS) + " names every paddock")
    return [(None if (n := f.properties.get(name_col)) is None else str(n), f.shape) for f in layer]


def resources(layer: Layer, id_col: str | None = None, type_col: str | None = None) -> list[Resource]:
    """Resources of a layer; without ``id_col`` they are numbered from 1."""
    for c in (id_col, type_col):
        if c is not None and layer and not any(c in f.properties for f in layer):
            raise ValueError(f"no column {c!r}")
    text = lambda v: None if v is None else str(v)
    return [Resource(text(f.properties.get(id_col)) if id_col else str(k), (), text(f.properties.get(type_col)) if type_col else None, shape=f.shape) for k, f in enumerate(layer, 1)]


def _layer_table(df: DataFrame, order_col: str, name_col: str, kind_col: str | None, geometry_col: str, crs: int) -> LayerTable:
    kind = F.lit(None).cast("string") if kind_col is None else F.col(kind_col).cast("string")
    return LayerTable(df.filter(F.col(geometry_col).isNotNull()).select(F.col(order_col).cast("long").alias("layer_no"), F.col(name_col).cast("string").alias("name"), kind.alias("kind"), F.col(geometry_col).alias("geometry")), crs)


def paddock_table(df: DataFrame, order_col: str, name_col: str, geometry_col: str = "geometry", crs: int = 4326) -> LayerTable:
    """Paddocks that stay a table; ``order_col`` has unique values and says which of two overlapping paddocks comes first."""
    return _layer_table(df, order_col, name_col, None, geometry_col, crs)


def resource_table(df: DataFrame, order_col: str, id_col: str, type_col: str | None = None, geometry_col: str = "geometry", crs: int = 4326) -> LayerTable:
    """Resources that stay a table; ``order_col`` has unique values and decides between equally near ones."""
    return _layer_table(df, order_col, id_col, type_col, geometry_col, crs)
