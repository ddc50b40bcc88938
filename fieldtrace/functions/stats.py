"""Aggregates over numbers that may be missing: nulls, NaN and infinities are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.geo import finite


def mean(x: Column) -> Column:
    return F.avg(finite(x))


def quantile(x: Column, p: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(finite(x), F.lit(p))


def constant(c: str) -> Column:
    """The one value that a group holds, nulls aside, or null."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def proportion(x: Column, n: Column) -> Column:
    return F.try_divide(x.cast("double"), n.cast("double"))


def label(threshold: float) -> str:
    """A threshold as part of a column name: 2.5 gives 2_5."""
    return f"{threshold:g}".replace(".", "_")


#: Bins for each unit of the scale on which values are counted: a few hundred thousand over the usual range of values.
_BINS = 1 << 14


def counted(df: DataFrame, value: Column) -> DataFrame:
    """``v, n``: the distinct finite values and how often each occurs."""
    return df.select(finite(value).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def quantiles(counts: DataFrame, probs: dict[str, float]) -> DataFrame:
    """One row: exact quantiles, with linear interpolation, of a table that ``counted`` gave; null where it is empty.

    The same numbers as ``quantile``, but no task holds all values: they are counted in narrow bins of a scale that keeps
    their order, and only what lies in the bins that hold the wanted ranks is ordered. Both steps read the counts from one
    shuffle.
    """
    table = counts.withColumn("_bin", F.floor(F.signum("v") * F.log1p(F.abs("v")) * _BINS))
    every = Window.partitionBy()
    at = {name: F.lit(float(p)) * (F.col("_all") - 1) for name, p in probs.items()}
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(x).cast("long").alias("rank"), (x - F.floor(x)).alias("share")) for name, x in at.items() for side, f in (("low", F.floor), ("high", F.ceil))])

    def holding(cells: DataFrame, within: list[str], order: str, wanted: Column, before: Column) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_below", before + F.coalesce(F.sum("n").over(w), F.lit(0)))
        hit = F.filter(wanted, lambda r: (r["rank"] >= F.col("_below")) & (r["rank"] < F.col("_below") + F.col("n")))
        return cells.withColumn("_wanted", hit).filter(F.size("_wanted") > 0)

    bins = table.groupBy("_bin").agg(F.sum("n").alias("n")).withColumn("_all", F.sum("n").over(every))
    bins = holding(bins, [], "_bin", ranks, F.lit(0)).select("_bin", F.col("_below").alias("_before"), F.col("_wanted").alias("_ranks"))
    values = table.join(F.broadcast(bins), "_bin")
    found = holding(values, ["_bin"], "v", F.col("_ranks"), F.col("_before")).select("v", F.explode("_wanted").alias("r"))
    pick = lambda name, side, c: F.max(F.when((F.col("r.name") == name) & (F.col("r.side") == side), c))
    one = found.agg(*[pick(name, side, F.col("v")).alias(f"{name}_{side}") for name in probs for side in ("low", "high")], *[pick(name, "low", F.col("r.share")).alias(f"{name}_share") for name in probs])
    low, high, share = (lambda name: F.col(f"{name}_low")), (lambda name: F.col(f"{name}_high")), (lambda name: F.col(f"{name}_share"))
    return one.select(*[F.when(low(n) == high(n), low(n)).otherwise((1 - share(n)) * low(n) + share(n) * high(n)).alias(n) for n in probs])
