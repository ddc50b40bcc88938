"""Exact n-gram Jaccard join by set-relation skipping.

Shingles are ordered by rarity (documents that hold them, then hash). A set posts only its prefix: pairs that reach the
threshold must share a shingle there. Skipping happens at two levels.

* Components: in each list, members are first compared with the most central set alone (the one that posts the shingle
  earliest). A member that is linked to it joins its component, and pairs inside one are not compared. This stands in
  place of deriving a set's list of answers from that of a similar set: components are what is returned, not links.
* Index: what is left (members outside the list's main component) probes the lists again, cut into blocks by set size
  and position. A probe names the blocks that can still hold a partner; all others are skipped.

Sets that are equal are one class from the start. Rarity is counted over all texts without a row per shingle: chunks of
texts ask hash buckets, each distinct shingle once a chunk, and get counts back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import NO_ID, materialise, pack, shuffle_partitions, unzipped, zipped
from fieldtrace.llm.components import components

CHUNK_BYTES = 6_000_000
BLOCK = 8
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: bytes, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; ASCII letters count in lower case.

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(width, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - k + 1, np.uint64(k) * _C)
        for i in range(k):
            s = (s ^ (s >> np.uint64(29))) * _A + h[i : len(h) - k + 1 + i] * _B
        s = (s ^ (s >> np.uint64(32))) * _B
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _sets(row: dict, width: int) -> Iterator[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(row["texts"])
    end = 0
    for size in unzipped(row["sizes"], "<u4").tolist():
        yield shingles(raw[end : end + size], width)
        end += size


def _asked(sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct shingles, how many of its sets hold each, and where each bucket begins."""
    found, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
    edges = np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)
    return found, counts, np.append(np.searchsorted(found, edges), len(found))


def rare_prefixes(chunks: DataFrame, tenths: int, width: int) -> DataFrame:
    """``doc_id, n, digest, tokens, places``: each set's size, digest, and prefix shingles that other rows hold too.

    ``tokens`` are the shared shingles of the prefix, ``places`` their positions in the order of rarity.
    """
    buckets = shuffle_partitions(chunks.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                found, counts, cuts = _asked(list(_sets(row, width)), buckets)
                short = found >> np.uint64(16)  # 48 bits do for counting: a rare clash only shifts the order
                out = []
                for k in range(buckets):
                    part = short[cuts[k] : cuts[k + 1]]
                    if len(part):
                        step = np.diff(part, prepend=np.uint64(0)).astype("<u8")
                        out.append((k, len(part), zipped(step), zipped(np.minimum(counts[cuts[k] : cuts[k + 1]], 65535).astype("<u2"))))
                if out:
                    yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]] * len(out), "bucket": pa.array([x[0] for x in out], pa.int32()), "steps": pa.array([x[2] for x in out], pa.binary()), "held": pa.array([x[3] for x in out], pa.binary())})

    asked = chunks.mapInArrow(ask, "chunk string, bucket int, steps binary, held binary").repartition(buckets, "bucket")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                by_bucket.setdefault(r["bucket"], []).append((r["chunk"], np.cumsum(unzipped(r["steps"], "<u8"), dtype=np.uint64), unzipped(r["held"], "<u2")))
        for bucket, parts in by_bucket.items():
            tokens, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([p[2] for p in parts]), minlength=len(tokens)).astype("<u4")
            end = 0
            for chunk, part, _ in parts:
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "bucket": pa.array([bucket], pa.int32()), "totals": pa.array([zipped(total[inverse[end : end + len(part)]])], pa.binary())})
                end += len(part)

    answers = asked.mapInArrow(answer, "chunk string, bucket int, totals binary")

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.concatenate([np.empty(0, np.uint32), *(unzipped(x.as_py(), "<u4") for x in right.sort_by("bucket").column("totals"))])
        out: dict[str, list] = {"doc_id": [], "n": [], "digest": [], "tokens": [], "places": []}
        for row in left.to_pylist():
            sets = list(_sets(row, width))
            found = _asked(sets, buckets)[0]
            if len(found) != len(total):
                raise ValueError("a chunk and the answers to it differ")
            for doc, s in zip(unzipped(row["ids"], "<i8").tolist(), sets, strict=True):
                n = len(s)
                held = total[np.searchsorted(found, s)]
                prefix = n - -(-tenths * n // 10) + 1
                order = np.lexsort((s, held))[:prefix] if n * (10 - tenths) >= tenths else np.empty(0, np.int64)  # smaller sets have no unequal partner
                shared = np.flatnonzero(held[order] > 1)
                pick = order[shared]
                out["doc_id"].append(doc)
                out["n"].append(n)
                mixed = pd.util.hash_array(s) if n else s
                with np.errstate(over="ignore"):
                    digest = (s.sum(dtype=np.uint64), (mixed * _A ^ (mixed >> np.uint64(17))).sum(dtype=np.uint64))
                out["digest"].append(f"{n:x}-{int(digest[0]):016x}{int(digest[1]):016x}")
                out["tokens"].append(s[pick].astype("<u8").tobytes())
                out["places"].append(shared.astype("<i4").tobytes())
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "digest": pa.string(), "tokens": pa.binary(), "places": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(choose, "doc_id long, n long, digest string, tokens binary, places binary")


def _postings(classes: DataFrame) -> DataFrame:
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            tokens = [np.frombuffer(r["tokens"], "<i8") for r in rows]
            sizes = np.array([len(t) for t in tokens])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens or [np.empty(0, np.int64)])), pa.array(np.repeat(np.array([r["cls"] for r in rows], np.int64), sizes)), pa.array(np.repeat(np.array([r["n"] for r in rows], np.int64), sizes)), pa.array(np.concatenate([np.frombuffer(r["places"], "<i4") for r in rows] or [np.empty(0, np.int32)]))],
                ["token", "cls", "n", "pos"],
            )

    rows = classes.filter(F.length("tokens") > 0).select("cls", "n", "tokens", "places").mapInArrow(opened, "token long, cls long, n long, pos int")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    return rows.join(shared, "token")


def _can_link(t: int, nx: str, i: str, ny: str, j: str) -> str:
    """Length and positional filter: the overlap that positions leave reaches t/10 of the union."""
    w = 10 + t
    return f"{t} * {nx} <= 10 * {ny} and {t} * {ny} <= 10 * {nx} and {w} * ({nx} - {i}) >= {t} * ({nx} + {ny}) and {w} * ({ny} - {j}) >= {t} * ({nx} + {ny})"


def _verify(pairs: DataFrame, texts: DataFrame, tenths: int, width: int) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets reach the threshold."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            ok = []
            a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, (x, y) in enumerate(zip(a_ids, b_ids, strict=True)):
                if len(kept) > 64:
                    kept.clear()
                if x not in kept:
                    kept[x] = shingles((b.column(2)[k].as_py() or "").encode("utf-8", "surrogatepass"), width)
                sx, sy = kept[x], shingles((b.column(3)[k].as_py() or "").encode("utf-8", "surrogatepass"), width)
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                ok.append((10 + tenths) * both >= tenths * (len(sx) + len(sy)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(checked, "a long, b long")


def join(docs: DataFrame, tenths: int = 9, width: int = 3) -> DataFrame:
    """Documents whose sets of ``width``-word shingles have a Jaccard similarity of ``tenths``/10 or more, linked.

    One row per row of ``docs``: ``doc_id, n_shingles, class_id`` (smallest doc_id with an equal set) and
    ``component_id`` (smallest doc_id reachable by links, itself included). Words are runs of non-space characters,
    ASCII letters in lower case. Null and empty texts have no shingles and link with nothing, not even each other.
    An empty table gives an empty table; repeated rows come out as often as they come in; rows that share a
    ``doc_id`` but not a text each have a row, under the one id, and are compared by the greatest of the texts. Other columns are ignored. Shingles compare by
    64-bit hash.
    """
    chunks = materialise(pack(docs, CHUNK_BYTES), "join-chunks")
    found = materialise(rare_prefixes(chunks, tenths, width), "join-prefixes")
    some = found.filter("n > 0")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "tokens", "places")).alias("x")).select("digest", F.col("x.doc_id").alias("cls"), F.col("x.n").alias("n"), F.col("x.tokens").alias("tokens"), F.col("x.places").alias("places"))
    classes = materialise(classes, "join-classes")
    posts = materialise(_postings(classes), "join-postings")
    ids = posts.select("cls").distinct()
    texts = materialise(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("cls"), "text").join(ids, "cls").groupBy("cls").agg(F.max("text").alias("text")), "join-texts")

    # Answers: each member against the central set with which it shares most lists.
    head = posts.groupBy("token").agg(F.min(F.struct("pos", "cls", "n")).alias("h")).select("token", F.col("h.cls").alias("hc"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hp"))
    near = posts.join(head, "token").filter("cls != hc").filter(_can_link(tenths, "n", "pos", "hn", "hp")).groupBy("cls", "hc").agg(F.count(F.lit(1)).alias("c"))
    best = near.groupBy("cls").agg(F.min(F.struct((-F.col("c")).alias("c"), "hc")).alias("m")).select(F.col("m.hc").alias("a"), F.col("cls").alias("b"))
    links = materialise(_verify(best, texts, tenths, width), "join-links")
    found_so_far = components(links)

    # Index: members outside a list's main component probe the blocks that can hold a partner.
    labelled = posts.join(found_so_far.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    main = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("token", F.col("m.comp").alias("main"))
    step = log(10 / tenths)
    open_ = materialise(labelled.join(main, "token").withColumn("band", F.floor(F.log(F.col("n")) / step).cast("int")).withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int")), "join-open")
    probes = (
        open_.filter("comp != main").select("token", F.col("cls").alias("pc"), F.col("comp").alias("pcomp"), F.col("n").alias("pn"), F.col("pos").alias("pp"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
        .withColumn("least", F.greatest(F.ceil(F.exp(F.col("band") * step) - 1e-6), F.ceil(F.col("pn") * tenths / 10.0 - 1e-6)))
        .withColumn("most", F.least(F.floor(F.exp((F.col("band") + 1) * step) + 1e-6), F.floor(F.col("pn") * 10.0 / tenths + 1e-6)))
        .filter(f"least <= most and {10 + tenths} * (pn - pp) >= {tenths} * (pn + least)")
        .withColumn("far", F.floor((10 * F.col("most") - tenths * F.col("pn")) / (10.0 + tenths) + 1e-6)).filter("far >= 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.floor(F.col("far") / BLOCK).cast("int"))))
    )
    pairs = (
        probes.join(open_, ["token", "band", "block"]).filter("pcomp != comp and (comp = main or pc < cls)").filter(_can_link(tenths, "pn", "pp", "n", "pos"))
        .select(F.least("pc", "cls").alias("a"), F.greatest("pc", "cls").alias("b")).distinct()
    )
    rest = materialise(_verify(pairs, texts, tenths, width), "join-rest")
    final = components(links.union(rest))
    named = classes.join(final.withColumnRenamed("id", "cls"), "cls", "left").select("digest", "cls", F.coalesce("component", "cls").alias("component"))
    own = lambda c: F.nullif(F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")), F.lit(NO_ID))
    return found.join(named, "digest", "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), own("cls").alias("class_id"), own("component").alias("component_id"))


def keep_one(docs: DataFrame, tenths: int = 9, width: int = 3) -> DataFrame:
    """One document of each linked group, the one with the smallest doc_id; documents without words stay."""
    kept = join(docs, tenths, width).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*docs.columns)
