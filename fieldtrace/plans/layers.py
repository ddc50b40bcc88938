"""Paddocks and resources that the registered queries use: small ones given with the plan, and layers derived from fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.layer_index import LayerTable
from fieldtrace.operators.resources import Resource
from fieldtrace.sources.layers import paddock_table, resource_table

PADDOCKS = [
    ("north", [(149.999, -30.006), (150.012, -30.006), (150.012, -29.999), (149.999, -29.999)]),
    ("south", [(149.999, -30.014), (150.010, -30.014), (150.014, -30.006), (149.999, -30.006)]),
    ("corner", [(150.012, -30.012), (150.022, -30.012), (150.017, -30.001)]),
]
RESOURCES = [
    Resource("trough", ((150.004, -30.004),), "water"),
    Resource("dam", ((150.010, -30.010), (150.013, -30.010), (150.013, -30.008), (150.010, -30.008)), "water", True),
    Resource("fence", ((150.000, -30.012), (150.008, -30.012), (150.018, -30.002)), "shade"),
]


def _bounds(fixes: DataFrame) -> DataFrame:
    by = fixes.groupBy("sensor_id").agg(*[f(c).alias(f"{c}{k}") for c in ("lon", "lat") for k, f in ((0, F.min), (1, F.max))])
    return by.withColumn("no", F.substring("sensor_id", 2, 9).cast("long"))


def boxes(fixes: DataFrame) -> LayerTable:
    """A paddock for each sensor: the box around its fixes, as well-known text; boxes overlap."""
    corner = lambda x, y: F.concat_ws(" ", F.col(f"lon{x}").cast("string"), F.col(f"lat{y}").cast("string"))
    ring = F.concat_ws(", ", *[corner(*c) for c in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return paddock_table(_bounds(fixes).withColumn("geometry", F.concat(F.lit("POLYGON (("), ring, F.lit("))"))), "no", "sensor_id")


def corners(fixes: DataFrame) -> LayerTable:
    """A resource for each sensor, at the south-western corner of its box."""
    where = F.concat(F.lit("POINT ("), F.col("lon0").cast("string"), F.lit(" "), F.col("lat0").cast("string"), F.lit(")"))
    return resource_table(_bounds(fixes).withColumns({"geometry": where, "kind": F.when(F.col("no") % 2 == 0, "water").otherwise("shade")}), "no", "sensor_id", "kind")
