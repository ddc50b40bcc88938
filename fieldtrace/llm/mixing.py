"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get word targets by weight (capped at a number of repeats, the excess reshared). Each source is dealt
into hash shards; a shard lays its documents end to end in a seeded order and cuts them into blocks of
``block_words``. Highest quotients turn the targets into whole numbers of blocks per source, then per group of shards
and per shard; inside a shard every block is taken the same number of times, and a seeded choice of blocks once more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import materialise, shuffle_partitions, words

BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
#: Shards of a source that share one apportionment; groups of shards share another, so no window holds all shards.
GROUP_SHARDS = 1000


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Word targets of sources.

    ``sources`` has ``source`` and ``source_size``. In code-point order, null last, sources weigh ``weights``,
    repeating. Together they get as many words as there are; a source stops at ``max_repeat`` times its size and
    the excess is shared again by weight. Sorted by cap over weight, the capped sources come first, so the
    repeated resharing is one running sum. An empty table gives an empty table; sources without words get 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("src", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    left = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("w_total", F.sum("weight").over(everything))
        .withColumn("words_left", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("w_left", F.col("w_total") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.col("words_left") / F.col("w_left"))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    )
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return left.withColumn("target", target).select("src", "source", "source_size", "weight", "target")


def sainte_lague(cells: DataFrame, weight: str, seats: str, within: list[str], order: str) -> DataFrame:
    """Add ``quota``: each cell's seats by highest quotients weight / (2k + 1) among the cells of ``within``.

    The divisor that gives all seats can differ from the mean weight a seat by at most cells / (2 * seats), so only
    the quotients that close to the ideal share compete; all lower ones have won. Cells without weight get none.
    """
    group = Window.partitionBy(*within)
    ideal = (
        cells.withColumn("_w", F.sum(weight).over(group))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_ideal", F.when(F.col("_w") > 0, F.col(weight) * F.col(seats) / F.col("_w")).otherwise(F.lit(0.0)))
        .withColumn("_slack", F.when(F.col("_w") > 0, F.col(weight) * F.col("_n") / F.col("_w")).otherwise(F.lit(0.0)) + F.lit(2.0))
        .withColumn("_low", F.greatest(F.floor(F.col("_ideal") - F.col("_slack")), F.lit(0)).cast("long"))
        .withColumn("_high", F.ceil(F.col("_ideal") + F.col("_slack")).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    )
    kept = cells.columns
    tried = ideal.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high")))).withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    ranked = tried.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.col("_q").desc(), order, "_k")))
    won = F.sum(((F.col("_rank") <= F.col("_open")) & (F.col(weight) > 0)).cast("long"))
    return ranked.groupBy(*kept, "_low").agg(won.alias("_won")).withColumn("quota", F.col("_low") + F.col("_won")).drop("_low", "_won")


def _seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeat: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 20,
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has ``doc_id, text, source``; other columns are ignored. One row per input row: ``doc_id, source, size,
    source_size, target, taken, repeats``. ``taken`` counts repeats: the whole document
    ``repeats`` times and, where blocks cut it, part of it once more (up to ``max_repeat`` times in all).
    Null and empty texts have size 0 and are never taken; a null source is a source of its own, last in order. An
    empty table gives an empty table. Rows that repeat a ``doc_id`` are documents of their own; equal rows differ
    only in which of them a block cuts. The seed and the ids decide everything, so reruns agree.
    """
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size")), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    targets = targets.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1)).cast("long"))
    placed = (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "t.src", "t.shards")
        .withColumn("shard", F.pmod(_seeded(seed, F.col("doc_id")), F.col("shards")))
    )
    laid = Window.partitionBy("src", "shard").orderBy(_seeded(seed + 1, F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = placed.withColumn("end", F.sum("size").over(laid)).withColumn("start", F.col("end") - F.col("size"))

    cells = placed.groupBy("src", "shard").agg(F.sum("size").alias("cell_words"), F.first("target").alias("target"), F.first("source_size").alias("source_size")).filter("cell_words > 0")
    cells = cells.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS)).withColumn("blocks", F.ceil(F.col("cell_words") / F.lit(block_words)).cast("long"))
    sources = cells.groupBy("src").agg(F.sum("blocks").alias("src_blocks"), (F.first("target") * F.sum("blocks") / F.first("source_size")).alias("want"))
    sources = sources.withColumn("one", F.lit(1)).withColumn("seats", F.round(F.sum("want").over(Window.partitionBy("one"))).cast("long"))
    per_source = sainte_lague(sources, "want", "seats", ["one"], "src").select("src", F.least(F.col("quota"), F.col("src_blocks") * max_repeat).alias("seats"))
    groups = cells.groupBy("src", "group").agg(F.sum("blocks").alias("group_blocks")).join(per_source, "src").withColumn("blocks_w", F.col("group_blocks").cast("double"))
    per_group = sainte_lague(groups, "blocks_w", "seats", ["src"], "group").select("src", "group", F.least(F.col("quota"), F.col("group_blocks") * max_repeat).alias("seats"))
    cells = cells.withColumn("blocks_w", F.col("blocks").cast("double")).join(per_group, ["src", "group"])
    per_cell = sainte_lague(cells.select("src", "group", "shard", "cell_words", "blocks", "blocks_w", "seats"), "blocks_w", "seats", ["src", "group"], "shard")
    per_cell = per_cell.withColumn("quota", F.least(F.col("quota"), F.col("blocks") * max_repeat))

    per_cell = per_cell.repartition(shuffle_partitions(docs.sparkSession), "src", "shard")  # before the blocks come out, not after
    blocks = per_cell.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    drawn = Window.partitionBy("src", "shard").orderBy(_seeded(seed + 2, F.col("src"), F.col("shard"), F.col("block")), "block")
    along = Window.partitionBy("src", "shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("rounds", F.floor(F.col("quota") / F.col("blocks")).cast("long"))
        .withColumn("times", F.col("rounds") + (F.row_number().over(drawn) <= F.col("quota") - F.col("rounds") * F.col("blocks")).cast("long"))
        .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("cell_words") - F.col("block") * block_words))
        .withColumn("before", F.coalesce(F.sum(F.col("times") * F.col("words")).over(along), F.lit(0)))
        .select("src", "shard", "block", "times", "rounds", "before")
    )
    spans = spans.withColumn("b0", F.floor(F.col("start") / block_words).cast("long")).withColumn("b1", F.floor((F.col("end") - 1) / block_words).cast("long"))
    low = blocks.select("src", "shard", F.col("block").alias("b0"), F.col("times").alias("t0"), F.col("before").alias("f0"), "rounds")
    high = blocks.select("src", "shard", F.col("block").alias("b1"), F.col("times").alias("t1"), F.col("before").alias("f1"))
    at_start = F.col("f0") + (F.col("start") - F.col("b0") * block_words) * F.col("t0")
    at_end = F.col("f1") + (F.col("end") - F.col("b1") * block_words) * F.col("t1")
    return (
        # A side of blocks comes out of few rows, so its size is guessed far too low: without the hint it is broadcast.
        spans.join(low.hint("merge"), ["src", "shard", "b0"], "left").join(high.hint("merge"), ["src", "shard", "b1"], "left")
        .withColumn("taken", F.when(F.col("size") > 0, at_end - at_start).otherwise(F.lit(0)).cast("long"))
        .withColumn("repeats", F.when(F.col("size") > 0, F.col("rounds")).otherwise(F.lit(0)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "repeats")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    A document is repeated as often as its taken words fill it; what is left over, words that a block edge cut off,
    is made whole or dropped along the seeded order of its source and shard, with what earlier documents got too much
    or too little carried on. So texts stay whole, and the words emitted for a source and shard differ from those that
    its blocks take by half of its longest cut document at most. Documents that the mix does not take go. Equal
    ``doc_id`` rows, and rows without one, share one plan row.
    """
    seed, shard_words = options.get("seed", 20), options.get("shard_words", SHARD_WORDS)
    plan = mix_sources(docs, **options).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("source_size").alias("source_size"), F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    shards = F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1)).cast("long")
    plan = plan.filter("_taken > 0").select("doc_id", "source", F.pmod(_seeded(seed, F.col("doc_id")), shards).alias("_shard"), _seeded(seed + 1, F.col("doc_id")).alias("_order"), "_taken", "_size")

    def rounded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "doc_id"])
        times, owed = [], 0
        for taken, size in zip(part["_taken"].tolist(), part["_size"].tolist(), strict=True):
            whole, cut = divmod(taken, size)
            more = int(cut > 0 and 2 * (owed + cut) >= size)
            owed += cut - more * size
            times.append(whole + more)
        return pd.DataFrame({"doc_id": part["doc_id"], "_times": times})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _times int"
    plan = plan.groupBy("source", "_shard").applyInPandas(rounded, schema).filter("_times > 0").withColumnRenamed("doc_id", "_id")
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return joined.select(*docs.columns)
