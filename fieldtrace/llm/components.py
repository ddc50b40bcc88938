"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in ``links``.

    Each round points the larger neighbours of a node at its smallest neighbour (large star), then a node and its
    smaller neighbours at the smallest of them (small star); rounds grow with the logarithm of the longest path.
    Nulls and self links don't count. An empty table gives an empty table. Only counts reach the driver.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    edges = materialise(edges, "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).distinct()
        edges = materialise(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(2**40)))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    roots = edges.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots)
