"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

The tokens of a line are its word shingles. Lines with equal sets are one class, and classes are joined in two steps.

* Which lines can have a partner at all: of each class a pool, the tokens with the lowest hashes, is counted. Two similar
  lines are bound to share several tokens of their pools, so a line with fewer tokens that other pools hold too is out.
* The join itself, over whole sets of the lines left: tokens are ordered by rarity, tokens of one line alone first; a
  line posts its prefix; lists are thinned by length and position, first against a list's earliest and most central
  line (one match settles a line), then block by block; intersections verify.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import SPACES, materialise

WIDTH, TENTHS = 5, 8
#: Bits of a token's hash while pools are counted: a clash only keeps a line that could go.
TOKEN_BITS = 40
#: The numbers of lines to read again are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 64_000_000
#: Positions of a list that make one block.
BLOCK = 8
#: Rounds go on while each settles a line, until a line left shares a list with so many others left at the mean.
ROUNDS_UNTIL = 4


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through explode() of one value: it is computed once, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _ceil(num: int, x: str, den: int) -> str:
    return f"cast(floor(({num} * ({x}) + {den - 1}) / {den}) as int)"


def _sets(lines: DataFrame, width: int) -> DataFrame:
    """Replace ``line`` by ``sh``, the sorted distinct hashes of its word shingles (with fewer words, of all its words), and ``n``, their number."""
    df = _once(lines, "wh", F.transform(F.array_remove(F.split(F.lower("line"), SPACES), ""), lambda w: F.xxhash64(w))).drop("line")
    many = F.transform(F.sequence(F.lit(0), F.size("wh") - width), lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(width)]))
    sh = F.when(F.size("wh") >= width, F.sort_array(F.array_distinct(many))).when(F.size("wh") > 0, F.array(F.xxhash64("wh"))).otherwise(F.array().cast("array<bigint>"))
    return _once(df, "sh", sh).drop("wh").withColumn("n", F.size("sh"))


def _may(tenths: int) -> str:
    """Length and positional filter for postings x and y: the overlap that positions leave reaches what the pair needs."""
    w = 10 + tenths
    return f"{tenths} * nx <= 10 * ny and {tenths} * ny <= 10 * nx and {w} * (nx - px) >= {tenths} * (nx + ny) and {w} * (ny - py) >= {tenths} * (nx + ny)"


def earlier_matches(docs: DataFrame, tenths: int = TENTHS, width: int = WIDTH) -> DataFrame:
    """``doc_id, line_no, first_doc_id, first_line_no``: lines to remove, and for each an earlier line that it matches.

    A line matches an earlier one, by (doc_id, line_no), if their sets of ``width``-word shingles (lower case) have a
    Jaccard similarity of ``tenths``/10 or more. Earlier lines count whether or not they are removed themselves.
    Lines without words, null and empty texts match nothing. Rows that share a doc_id share its line numbers: lines
    at one place don't remove each other. Rows without a doc_id have no place: they lose no line and remove none. An empty
    table gives an empty table.
    """
    docs = docs.filter("doc_id is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    sets = _sets(lines, width).filter("n > 0")
    extra = _ceil(1, "n", 20)
    sized = sets.withColumn("s", F.when(F.col("n") * (10 - tenths) >= tenths, F.least(F.col("n"), F.col("n") - F.expr(_ceil(tenths, "n", 10)) + 1 + F.expr(extra))).otherwise(F.lit(0)))
    placed = materialise(sized.select("doc_id", "line_no", F.xxhash64("sh").alias("h1"), F.xxhash64(F.lit(1), "sh").alias("h2"), "n", "s", F.transform(F.slice("sh", F.lit(1), F.col("s")), lambda h: F.pmod(h, F.lit(1 << TOKEN_BITS))).alias("pool")), "lines")
    classes = placed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "n", "s", "pool")).alias("x"), F.count(F.lit(1)).alias("c"))
    classes = materialise(classes.select("h1", "h2", "c", F.struct("x.doc_id", "x.line_no").alias("cls"), "x.n", "x.s", "x.pool"), "line-classes")

    # The rows of this shuffle are the most: a token and the place of a line, nothing else.
    held = classes.select("cls.doc_id", "cls.line_no", F.explode("pool").alias("token"))
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token")
    shared = held.join(df, "token").groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("shared"))
    # Partners are at least tenths/10 as long; the pools of both are bound to share their extra tokens and one more.
    able = shared.join(classes.select("cls.*", "n"), ["doc_id", "line_no"]).filter(F.col("shared") > F.expr(_ceil(1, _ceil(tenths, "n", 10), 20)))
    asked = materialise(able.groupBy("doc_id").agg(F.collect_list("line_no").alias("nos")), "line-places")  # at most a document's own lines
    if (asked.agg(F.sum(24 + 4 * F.size("nos"))).first()[0] or 0) <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    texts = docs.select("doc_id", "text").join(asked, "doc_id")
    texts = texts.select("doc_id", F.explode(F.array(F.split("text", "\n"))).alias("all"), "nos").select("doc_id", F.explode("nos").alias("line_no"), "all").select("doc_id", "line_no", F.get("all", F.col("line_no")).alias("line"))
    own = _sets(texts.filter("line is not null"), width).groupBy("doc_id", "line_no").agg(F.max("sh").alias("sh"))
    own = materialise(own.select(F.struct("doc_id", "line_no").alias("cls"), "sh", F.size("sh").alias("n")), "line-sets")

    held = own.select("cls", "n", F.explode("sh").alias("token"))
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    listed = held.join(df, "token").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most a line's own set
    # Tokens of one line alone lead the order and post nothing.
    alone, prefix = F.col("n") - F.size("t"), F.col("n") - F.expr(_ceil(tenths, "n", 10)) + 1
    posts = listed.filter(prefix > alone).select("cls", "n", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), prefix - alone)).alias("k", "x"))
    posts = materialise(posts.select("cls", "n", (F.col("alone") + F.col("k")).alias("p"), "x.token"), "line-postings")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = own.select(F.col("cls").alias("x"), F.col("sh").alias("a")), own.select(F.col("cls").alias("y"), F.col("sh").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        return pairs.join(x, "x").join(y, "y").filter((10 + tenths) * both >= tenths * (F.size("a") + F.size("b"))).select("x", "y")

    me = posts.select("token", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"))
    # Rounds: lines not settled yet against the earliest and the most central of them in each list; one match settles a line.
    settled, found, open_ = None, -1, me
    while True:
        heads = open_.groupBy("token").agg(F.min(F.struct("x", "nx", "px")).alias("e"), F.min(F.struct("px", "x", "nx")).alias("m"))
        heads = heads.select("token", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{h}.{c}x").alias(f"{c}y") for c in ("", "n", "p")]) for h in "em"]))).alias("h"))
        heads = heads.select("token", F.col("h.y").alias("y"), F.col("h.ny").alias("ny"), F.col("h.py").alias("py"))
        tried = open_.join(heads, "token").filter("x != y").filter(_may(tenths)).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        got = materialise(verified(tried), "line-settled")
        settled = got if settled is None else settled.union(got)
        before, found = found, settled.select("x").distinct().count()
        open_ = me.join(settled.select("x").distinct(), "x", "left_anti")
        left = open_.groupBy("token").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
        if found == before or (left[0] or 0) <= ROUNDS_UNTIL * (left[1] or 0):
            break
    # What no head settles probes the blocks of its lists that can hold a partner; a band holds sizes up to 10/tenths times its least.
    step = log(10 / tenths)
    banded = me.withColumn("band", F.floor(F.log("nx") / step).cast("int")).withColumn("block", F.floor(F.col("px") / BLOCK).cast("int"))
    probes = (
        open_.withColumn("band", F.floor(F.log("nx") / step).cast("int")).withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
        .withColumn("least", F.greatest(F.ceil(F.exp(F.col("band") * step) - 1e-6), F.ceil(F.col("nx") * tenths / 10.0 - 1e-6)))
        .withColumn("most", F.least(F.floor(F.exp((F.col("band") + 1) * step) + 1e-6), F.floor(F.col("nx") * 10.0 / tenths + 1e-6)))
        .filter(f"least <= most and {10 + tenths} * (nx - px) >= {tenths} * (nx + least)")
        .withColumn("far", F.floor((10 * F.col("most") - tenths * F.col("nx")) / (10.0 + tenths) + 1e-6)).filter("far >= 0")
        .select("token", "x", "nx", "px", "band", F.explode(F.sequence(F.lit(0), F.floor(F.col("far") / BLOCK).cast("int"))).alias("block"))
    )
    others = banded.select("token", "band", "block", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("px").alias("py"))
    pairs = probes.join(others, ["token", "band", "block"]).filter("y < x").filter(_may(tenths)).select("x", "y").distinct()
    matches = materialise(settled.union(verified(pairs)), "line-matches")
    first = matches.groupBy("x").agg(F.min("y").alias("w")).withColumnRenamed("x", "cls")
    witness = classes.join(first, "cls", "left").select("h1", "h2", "c", "cls", F.coalesce("w", "cls").alias("w")).filter("c > 1 or w < cls").drop("c", "cls")
    hit = placed.select("doc_id", "line_no", "h1", "h2").join(witness, ["h1", "h2"]).filter(F.col("w") < F.struct("doc_id", "line_no"))
    return hit.select("doc_id", "line_no", F.col("w.doc_id").alias("first_doc_id"), F.col("w.line_no").alias("first_line_no")).distinct()


def removed_lines(docs: DataFrame, tenths: int = TENTHS, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_removed, removed``: by document, the sorted numbers of the lines to remove (from 0), comma between.

    One row per doc_id with such lines.
    """
    gone = earlier_matches(docs, tenths, width).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("nos"))
    return gone.select("doc_id", F.size("nos").cast("long").alias("n_removed"), "nos")


def dedup_lines(docs: DataFrame, tenths: int = TENTHS, width: int = WIDTH) -> DataFrame:
    """``docs`` without later matches of earlier lines, columns as they were (``n_chars``, if there, counted anew).

    Documents whose lines are all removed go: every line of theirs stays elsewhere. Null and empty texts stay.
    """
    gone = removed_lines(docs, tenths, width).select("doc_id", F.col("nos").alias("_nos"))
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_nos", i))
    joined = docs.join(gone, "doc_id", "left").withColumn("_left", F.when(F.col("_nos").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    kept = joined.filter(F.col("_nos").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]")).withColumn("text", F.col("_left"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_nos").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
