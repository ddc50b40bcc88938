"""Phrase collocations: counts of all phrases from one count of longest windows, summed by a roll-up.

Every word begins one window of five; its lead columns are padded where the piece ends. A phrase occurs where a window
begins with it, so only longest windows are counted, and a ROLLUP over their columns sums every shorter prefix. Counts of
tasks meet packed, by buckets of windows, so the roll-up gets one row for each window, however many tasks hold it.

Phrases below the least count are of no use, nor is any phrase that holds one. So words, pairs, triples and fours are counted
by hash first, each where its shorter parts are frequent, and windows are padded from the end of the longest prefix on
that is not surely rare. What is frequent is told by a bitmap of fixed size: a frequent phrase is never padded away, a rare
one at most stays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import materialise, shuffle_partitions, unzipped, zipped

#: Capitals fold to small letters, a tab is a space, and a full stop stands for everything that ends a piece.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
CHUNK_BYTES = 16_000_000
#: Bits of the map of frequent phrases: 8 MB, whatever the corpus.
MAP_BITS = 26
_ROWS = 200_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """``lang, codes, words``: the texts of a language in a row; code 0 ends a piece, other codes are places in ``words``."""
    numbers: dict[str, defaultdict] = {}
    codes: dict[str, list[np.ndarray]] = defaultdict(list)
    held = 0

    def flush() -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        for lang, parts in codes.items():
            yield lang, np.concatenate(parts), [b"", *list(numbers[lang])[1:]]
        numbers.clear(), codes.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            if lang not in numbers:
                numbers[lang] = number = defaultdict()
                number.default_factory = number.__len__
                number[b"."]
            raw = text.as_py() or b""
            found = raw.translate(_FOLD).replace(b".", b" . ").split()
            found.append(b".")
            codes[lang].append(np.fromiter(map(numbers[lang].__getitem__, found), np.uint32, len(found)))
            held += len(raw) + 100
            if held >= chunk_bytes:
                yield from flush()
                held = 0
    yield from flush()


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    own = pd.util.hash_array(np.array([lang], dtype=object), categorize=False)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) ^ (own * _SPREAD)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of phrases and the words behind them, from those of both."""
    h = (a * _SPREAD) ^ (b + (a >> np.uint64(29)))
    return (h ^ (h >> np.uint64(32))) * _SPREAD


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - int(len(bits) * 64).bit_length() + 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _phrases(codes: np.ndarray, h: np.ndarray, bits: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where phrases of 1, 2, ... words begin, and their hashes: only those whose two shorter parts are marked frequent."""
    at = np.flatnonzero(codes > 0)
    hashes = h[codes[at]]
    yield at, hashes
    here = np.zeros(len(codes) + 1, bool)
    for size in range(2, longest + 1):
        marked = _is_set(bits, hashes)
        at, hashes = at[marked], hashes[marked]
        here[:] = False
        here[at] = True
        both = here[at + 1]
        at, hashes = at[both], hashes[both]
        hashes = _joined(hashes, h[codes[at + size - 1]])
        yield at, hashes


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text"))


def frequent_map(docs: DataFrame, least: int, longest: int, map_bits: int = MAP_BITS, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """A bitmap of ``2 ** map_bits`` bits in which all phrases of up to ``longest`` words that occur ``least`` times have theirs set.

    One pass a length: a phrase is counted only where its two shorter parts are marked, so what is shuffled shrinks fast.
    """
    bits = np.zeros(max(1, 2**map_bits // 64), np.uint64)
    for size in range(1, longest + 1):
        bits = bits | _marked(docs, bits, size, least, map_bits, chunk_bytes)
    return bits


def _marked(docs: DataFrame, bits: np.ndarray, size: int, least: int, map_bits: int, chunk_bytes: int) -> np.ndarray:
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, words in _chunks(batches, chunk_bytes):
            *_, (_, hashes) = _phrases(codes, _hashes(lang, words), sent.value, size)
            found, n = np.unique(hashes, return_counts=True)
            for k in range(0, len(n), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(found[k : k + _ROWS].view(np.int64)), pa.array(n[k : k + _ROWS].astype(np.int64))], ["h", "n"])

    often = _texts(docs).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    slots = often.select(F.shiftrightunsigned("h", 64 - map_bits).alias("slot"))
    cells = slots.select(F.shiftright("slot", 6).alias("cell"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** map_bits / 64 rows
    out = np.zeros(max(1, 2**map_bits // 64), np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def windows(docs: DataFrame, frequent: np.ndarray, longest: int = 5, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``lang, w1, ..., n``: longest windows with counts, a row for each; '' pads.

    A window is padded from the end of its piece on, or of its longest prefix that may be frequent. One whose first word is
    rare is all padding: its words still count for the language. A chunk packs its counts for each bucket of windows, and
    a bucket adds them up.
    """
    sent, buckets = docs.sparkSession.sparkContext.broadcast(frequent), np.uint64(2 * shuffle_partitions(docs.sparkSession))
    names = [f"w{k}" for k in range(1, longest + 1)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, codes, words in _chunks(batches, chunk_bytes):
            h, v = _hashes(lang, words), len(words)
            codes = np.concatenate([codes, np.zeros(longest, np.uint32)]).astype(np.int64)
            depth = np.zeros(len(codes), np.int8)
            for size, (at, hashes) in enumerate(_phrases(codes, h, sent.value, longest), 1):
                depth[at if size == longest > 1 else at[_is_set(sent.value, hashes)]] = size
            alone = np.bincount(codes[depth == 1], minlength=v)
            ones = np.flatnonzero(alone)
            rare = np.count_nonzero((codes > 0) & (depth == 0))
            columns = [np.concatenate([[0], ones])] + [np.zeros(len(ones) + 1, np.int64)] * (longest - 1)
            counts = np.concatenate([[rare], alone[ones]])
            at = np.flatnonzero(depth > 1)
            if len(at):
                # Windows are numbered prefix by prefix: the number of a prefix and its next word number the longer one.
                prefix, steps = codes[at], []
                for k in range(1, longest):
                    keys, prefix = np.unique(prefix * v + np.where(depth[at] > k, codes[at + k], 0), return_inverse=True)
                    steps.append(keys)
                n = np.bincount(prefix)
                tail, which = [], np.arange(len(n))
                for keys in reversed(steps):
                    tail.append(keys[which] % v)
                    which = keys[which] // v
                columns = [np.concatenate([a, b]) for a, b in zip(columns, [which, *reversed(tail)], strict=True)]
                counts = np.concatenate([counts, n])
            key = h[columns[0]]
            for c in columns[1:]:
                key = _joined(key, h[c])
            bucket = (key % buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            held, starts = np.unique(bucket[order], return_index=True)
            packed = []
            for own in np.split(order, starts[1:]):
                used, places = np.unique(np.concatenate([[0], *(c[own] for c in columns)]), return_inverse=True)
                packed.append((zstandard.ZstdCompressor(level=1).compress(b" ".join([words[c] for c in used])), zipped(places[1:].astype("<u4")), zipped(counts[own].astype("<i8"))))
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([lang] * len(held), pa.string()), *(pa.array(x, pa.binary()) for x in zip(*packed, strict=True))], ["bucket", "lang", "words", "places", "n"])

    def added(table: pa.Table) -> pa.Table:
        langs, number, parts = defaultdict(), defaultdict(), []
        langs.default_factory, number.default_factory = langs.__len__, number.__len__
        for r in table.select(["lang", "words", "places", "n"]).to_batches(max_chunksize=1_000):
            for lang, words, places, n in zip(*(c.to_pylist() for c in r.columns), strict=True):
                split = zstandard.ZstdDecompressor().decompress(words).split(b" ")
                own = np.fromiter(map(number.__getitem__, split), np.int32, len(split))
                n = unzipped(n, "<i8")
                parts.append([np.full(len(n), langs[lang], np.int32), *own[unzipped(places, "<u4")].reshape(longest, -1), n])
        one = pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], names=["lang", *names, "n"])
        one = one.group_by(["lang", *names], use_threads=False).aggregate([("n", "sum")])
        strings = pa.array(list(number), pa.binary()).cast(pa.string())
        return pa.table([pa.array(list(langs), pa.string()).take(one.column("lang")), *(strings.take(one.column(c)) for c in names), one.column("n_sum")], names=["lang", *names, "n"])

    schema = ", ".join(f"{c} string" for c in ["lang", *names])
    packed = _texts(docs).mapInArrow(counted, "bucket long, lang string, words binary, places binary, n binary")
    return packed.groupBy("bucket").applyInArrow(added, f"{schema}, n long")


def phrase_counts(docs: DataFrame, least: int, longest: int = 5, map_bits: int = MAP_BITS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``lang, size, words array<string>, f``: all phrases of at most ``longest`` words that occur ``least`` times or more.

    ``size`` 0, with no words, holds the number of all words of the language.
    """
    names = [f"w{k}" for k in range(1, longest + 1)]
    counted = windows(docs, frequent_map(docs, least, max(1, longest - 1), map_bits, chunk_bytes), longest, chunk_bytes)
    counted = counted.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("_level"))
    size = F.lit(longest) - F.bit_count("_level")  # a rolled-up column sets a bit
    words = F.filter(F.array(*names), lambda w: w.isNotNull() & (w != ""))
    rolled = rolled.withColumn("size", size).filter("size >= 0").withColumn("words", words)
    return rolled.filter((F.size("words") == F.col("size")) & ((F.col("size") == 0) | (F.col("f") >= least))).select("lang", "size", "words", "f")


def _text(words: Column) -> Column:
    return F.concat_ws(" ", words)


def scored(counts: DataFrame) -> DataFrame:
    """``lang, words, phrase, a, l, r, n, score`` of every phrase of two words or more, by the cut of lowest score."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    total = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    known = counts.filter("size > 0").select("lang", _text(F.col("words")).alias("_key"), "f")
    cuts = counts.filter("size > 1").select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("_first", _text(F.slice("words", F.lit(1), F.col("k")))).withColumn("_rest", _text(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))))
    cuts = cuts.join(known.select("lang", F.col("_key").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    cuts = cuts.join(known.select("lang", F.col("_key").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    cuts = cuts.join(total, "lang").withColumn("_over", F.lit(1000).cast("decimal(4,0)") * exact("a")).withColumn("_under", exact("l") * exact("r"))
    # Products of three counts pass 64 bits; 38 digits hold them up to 10^16 words.
    cuts = cuts.withColumn("score", F.expr("cast(cast(_over as decimal(22,0)) * cast(n as decimal(16,0)) as decimal(38,0)) div _under"))
    low = cuts.groupBy("lang", "words").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("_low"))
    return low.select("lang", "words", _text(F.col("words")).alias("phrase"), "a", "_low.l", "_low.r", "n", "_low.score")


def _inner(longest: int) -> Column:
    """Every shorter run of two words or more inside ``words``."""
    size = F.size("words")
    runs = [F.when((size > n) & (size >= at + n), _text(F.slice("words", at + 1, n))) for n in range(2, longest) for at in range(longest - n + 1)]
    return F.array_distinct(F.array_compact(F.array(*runs)))


def without_covered(candidates: DataFrame, longest: int = 5, share: int = 100) -> DataFrame:
    """Candidates that no longer candidate, itself dropped or not, holds with ``share`` percent of their count or more."""
    inner = candidates.select("lang", F.col("a").alias("_f"), F.explode(_inner(longest)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return candidates.join(most, ["lang", "phrase"], "left").filter(F.col("_f").isNull() | (100 * F.col("_f") < share * F.col("a"))).drop("_f")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, map_bits: int = MAP_BITS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``text, lang``; other columns are ignored. Null and empty texts have no words, a null language is
    ``und``, repeated rows count each, an empty table gives an empty table; ties of score and count go by phrase, so ranks
    are unique. Counts of all sizes cover all texts.
    """
    counts = materialise(phrase_counts(docs, least, longest, map_bits, chunk_bytes), "phrase-counts")
    found = without_covered(scored(counts), longest, share)
    by = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # First within parts of a language, so that no task orders a whole language.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*by)
    found = found.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
