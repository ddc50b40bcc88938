"""Quality rules: counts of words, symbols and repeats, and robust multivariate outliers by group.

The minimum covariance determinant of each (language, source) group, and of each language, is found by concentration
steps: from medians and median absolute deviations, keep the ``share`` of rows nearest by Mahalanobis distance, take their
mean and covariance, and repeat. A group's estimate is then drawn towards its language's, the more the fewer rows it has.
Everything is DataFrame functions; a group's state is one row of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import materialise, words

SYMBOLS = "#*$%&|<>"
#: The transformed statistics, and the least standard deviation each is granted: groups in which nearly every document has a zero would otherwise reject the first symbol or repeated line.
STATISTICS = {"word_length": 0.08, "symbol_rate": 0.6, "dup_line_rate": 0.6, "repeat_rate": 0.5}
#: Fixed values for four statistics: the 0.999999 quantile of chi-square, and the factor that makes the covariance of the nearest 75 % consistent for normal data.
CUTOFF, CONSISTENCY = 33.38, 1.48
SHARE, STEPS = 0.75, 5
#: How many rows a language's estimate weighs in the estimate of each of its groups.
PRIOR_ROWS = 40
#: The start's medians are of statistics cut to multiples of 1 / GRAIN, of which a group has a few thousand at most.
GRAIN = 1000
#: Up to so many groups their estimates (a row of under 300 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base counts of every row.

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``:
    lines with a word that equal an earlier line; ``n_repeat_words``: words in 3-word windows that occur twice or
    more, the first included (windows compare by 64-bit hash). Null and empty texts have zeros.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("w"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("lines"),
    )
    df = df.withColumn("n_words", F.size("w").cast("long"))
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.withColumn("h", F.when(F.col("n_words") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.filter("s", lambda x, i: F.coalesce((F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]), F.get("s", i - 1)["h"] == x["h"], F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("at", F.transform(twin, lambda x: x["i"]))
    repeated = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2)))))
    return df.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("at").isNull(), F.lit(0)).otherwise(repeated).cast("long").alias("n_repeat_words"),
    )


def _with_factor(estimates: DataFrame, names: list[str]) -> DataFrame:
    """Replace the sums of a group by means ``m_*`` and the factor ``l_*_*`` of its floored covariance, row after row of the factor."""
    mean = {a: F.col(f"s_{a}") / F.col("n") for a in names}
    out = estimates
    for i, a in enumerate(names):
        out = out.withColumn(f"m_{a}", mean[a])
        for j, b in enumerate(names[: i + 1]):
            cov = (F.col(f"p_{b}_{a}") / F.col("n") - mean[a] * mean[b]) * CONSISTENCY
            done = sum((F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}") for k in names[:j]), F.lit(0.0))
            if a == b:
                out = out.withColumn(f"l_{a}_{a}", F.sqrt(F.greatest(cov, F.lit(0.0)) + F.lit(STATISTICS[a] ** 2) - done))
            else:
                out = out.withColumn(f"l_{a}_{b}", (cov - done) / F.col(f"l_{b}_{b}"))
    return out.select("grp", *(f"m_{a}" for a in names), *(f"l_{a}_{b}" for i, a in enumerate(names) for b in names[: i + 1]))


def _distance(rows: DataFrame, names: list[str]) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i, a in enumerate(names):
        done = sum((F.col(f"l_{a}_{b}") * F.col(f"y_{b}") for b in names[:i]), F.lit(0.0))
        rows = rows.withColumn(f"y_{a}", (F.col(a) - F.col(f"m_{a}") - done) / F.col(f"l_{a}_{a}"))
    return rows.withColumn("d2", sum((F.col(f"y_{a}") ** 2 for a in names), F.lit(0.0)))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, share: float = SHARE, steps: int = STEPS, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """The base counts, ``base_failed``, the robust distance ``d2`` and ``kept`` of every row.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. Rows that pass are judged
    against the robust mean and covariance of their (lang, source) group, null a value of its own: with ``n`` rows in its
    core, ``n / (n + prior_rows)`` of them are the group's own and the rest is its language's, at every size.
    ``kept`` is false for base failures and for d2 > cutoff. Null and empty texts fail the base rules; where no row of a
    language passes, ``d2`` is null. An empty table gives an empty table; repeated rows count as often as they occur.
    """
    names = list(STATISTICS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    some = F.greatest(F.col("n_words"), F.lit(1))
    stats = text_counts(docs).withColumn("base_failed", failed).withColumn("tongue", part("lang")).withColumn("grp", F.concat("tongue", F.lit("\u0001"), part("source")))
    stats = (
        stats.withColumn("word_length", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / some))
        .withColumn("symbol_rate", F.log1p(100 * F.col("n_symbols") / some))
        .withColumn("dup_line_rate", F.log1p(20 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))))
        .withColumn("repeat_rate", F.log1p(20 * F.col("n_repeat_words") / some))
    )
    stats = materialise(stats, "quality-statistics")
    groups = materialise(stats.select("tongue", "grp").distinct(), "quality-groups")
    bounded = F.broadcast if groups.count() <= BROADCAST_GROUPS else lambda df: df
    # Each passing row counts in its group and in its language.
    passing = stats.filter("not base_failed").select(F.explode(F.array("grp", "tongue")).alias("grp"), *names)

    middle = lambda x: F.percentile(F.floor(x * GRAIN), F.lit(0.5)) / GRAIN
    centre = passing.groupBy("grp").agg(*[middle(F.col(a)).alias(f"m_{a}") for a in names])
    spread = passing.join(bounded(centre), "grp").groupBy("grp").agg(*[middle(F.abs(F.col(a) - F.col(f"m_{a}"))).alias(f"l_{a}_{a}") for a in names])
    start = centre.join(spread, "grp")
    for i, a in enumerate(names):
        start = start.withColumn(f"l_{a}_{a}", F.sqrt((1.4826 * F.col(f"l_{a}_{a}")) ** 2 + F.lit(STATISTICS[a] ** 2)))
        for b in names[:i]:
            start = start.withColumn(f"l_{a}_{b}", F.lit(0.0))
    estimate = materialise(start, "quality-start")
    for step in range(steps):
        near = _distance(passing.join(bounded(estimate), "grp"), names).withColumn("bin", F.floor(F.log2(F.col("d2") + F.lit(1e-9)) * 32))
        bins = near.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
        cum = bins.withColumn("below", F.sum("c").over(Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("c").over(Window.partitionBy("grp")))
        edge = cum.filter(F.coalesce(F.col("below"), F.lit(0)) < F.ceil(F.col("all") * share)).groupBy("grp").agg(F.max("bin").alias("edge"))
        nearest = near.join(bounded(edge), "grp").filter("bin <= edge")
        sums = [F.count(F.lit(1)).alias("n"), *(F.sum(a).alias(f"s_{a}") for a in names), *(F.sum(F.col(b) * F.col(a)).alias(f"p_{b}_{a}") for i, a in enumerate(names) for b in names[: i + 1])]
        cores = materialise(nearest.groupBy("grp").agg(*sums), f"quality-step{step}")
        estimate = _with_factor(cores, names)
    judged = _distance(stats.join(bounded(_with_factor(_drawn(groups, cores, names, prior_rows), names)), "grp", "left"), names)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("d2", 6).alias("d2"), kept.alias("kept"))


def _drawn(groups: DataFrame, cores: DataFrame, names: list[str], prior_rows: float) -> DataFrame:
    """Sums of one row for each group, with the mean and covariance that are its own and its language's by share."""
    pairs = [(b, a) for i, a in enumerate(names) for b in names[: i + 1]]
    mean = lambda t, a: F.col(f"{t}.s_{a}") / F.col(f"{t}.n")
    cov = lambda t, b, a: F.col(f"{t}.p_{b}_{a}") / F.col(f"{t}.n") - mean(t, a) * mean(t, b)
    both = groups.alias("k").join(cores.alias("g"), F.col("k.grp") == F.col("g.grp"), "left").join(cores.alias("t"), F.col("k.tongue") == F.col("t.grp"))
    w = F.coalesce(F.col("g.n") / (F.col("g.n") + F.lit(float(prior_rows))), F.lit(0.0))
    mix = lambda f: w * F.coalesce(f("g"), F.lit(0.0)) + (1 - w) * f("t")
    one = both.select(F.col("k.grp").alias("grp"), *[mix(lambda t, a=a: mean(t, a)).alias(f"s_{a}") for a in names], *[mix(lambda t, a=a, b=b: cov(t, b, a)).alias(f"p_{b}_{a}") for b, a in pairs])
    return one.select("grp", F.lit(1.0).alias("n"), *[f"s_{a}" for a in names], *[(F.col(f"p_{b}_{a}") + F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"p_{b}_{a}") for b, a in pairs])
