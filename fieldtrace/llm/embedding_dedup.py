"""Near-duplicate embeddings by spherical-cap filters from structured random product codes.

A direction of the filter code is a choice of one random vector in each of ``parts`` parts of the rotated space, so
``size ** parts`` directions need only ``parts * size`` small products. A vector is decoded to the list of all
directions whose inner product with it exceeds the threshold; vectors that share a direction are compared exactly.
The threshold rises with the number of vectors, and the number of directions with it: unrelated vectors then share a
direction about as seldom as there are vectors more, while a pair at the cosine asked for shares as many as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import materialise
from fieldtrace.llm.components import components

COSINE = 0.93
PARTS, SEED = 2, 7
#: Directions that a pair right at the cosine shares, and unrelated vectors that a vector is compared with, at the mean.
SHARED, UNRELATED = 31, 17


def both(t: float, cosine: float, dim: int) -> float:
    """The chance that a random direction has a product over ``t`` with both of two unit vectors at ``cosine``."""
    half = np.arccos(cosine) / 2
    top = np.arccos(t) - half
    if top <= 0:
        return 0.0
    angle = (np.arange(500) + 0.5) / 500 * top
    return float(np.mean(np.maximum(1 - (t / np.cos(angle + half)) ** 2, 0) ** ((dim - 2) / 2)) * top / np.pi)


def sized(vectors: int, cosine: float, dim: int, parts: int) -> tuple[int, int, float]:
    """Parts, vectors a part and threshold of the code for so many vectors with one label.

    The lowest threshold at which a vector meets UNRELATED others at most, and as many directions as give a pair at
    ``cosine`` SHARED of them. Few dimensions are one part.
    """
    parts = parts if dim >= 8 * parts else 1
    for t in np.arange(0.05, 0.9, 0.01):
        size = max(int(np.ceil((SHARED / both(t, cosine, dim)) ** (1 / parts))), 2)
        if vectors * size**parts * both(t, 0.0, dim) <= UNRELATED:
            break
    return parts, size, float(t)


def code(dim: int, parts: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and, for each part of the space, ``size`` random vectors of equal length."""
    rng = np.random.default_rng([seed, dim])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    books = []
    for part in np.array_split(np.arange(dim), min(parts, dim)):
        c = rng.normal(size=(size, len(part)))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(len(part) / dim))
    return rotation, books


def decode(x: np.ndarray, rotation: np.ndarray, books: list[np.ndarray], threshold: float) -> np.ndarray:
    """All directions (numbers in mixed radix) whose product with the unit vector ``x`` exceeds ``threshold``.

    The sums of the first and of the last parts are tabled apart; for each of the first, the sorted last ones that
    lift it over the threshold are a run from the top.
    """
    y, at, sums = x @ rotation, 0, []
    for book in books:
        sums.append(book @ y[at : at + book.shape[1]])
        at += book.shape[1]
    half = (len(sums) + 1) // 2

    def table(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1)
        for p in parts:
            out = (out[:, None] + p[None, :]).reshape(-1)
        return out

    first, last = table(sums[:half]), table(sums[half:])
    order = np.argsort(-last, kind="stable")
    runs = np.searchsorted(-last[order], first - threshold, side="right")
    starts = np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(np.arange(len(first)), runs) * len(last) + order[np.arange(runs.sum()) - starts]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, parts: int = PARTS, seed: int = SEED) -> DataFrame:
    """Vectors with a cosine of ``cosine`` or more, linked within equal labels.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored. One row per vec_id: ``vec_id, n_links``
    (other vectors linked directly), ``component_id`` (smallest vec_id reachable by links, itself included) and
    ``kept`` (vec_id = component_id). Vectors without a label, null, all zero, or with a null or non-finite component
    link with nothing; so do vectors of unequal length, and vectors without a vec_id, which are one row. An empty table gives an empty table; of rows that share a
    vec_id the one with the largest label and vector counts. Equal vectors are one class with a count. Links found
    are exact; a pair right at the cosine shares a direction with a chance of about 0.97.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("x")).select("vec_id", F.col("x.label").alias("label"), F.col("x.embedding").alias("embedding"))
    good = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = materialise(rows.withColumn("key", F.when(good & F.col("vec_id").isNotNull(), F.sha2(F.to_json(F.struct("label", "embedding")), 256))), "vectors")
    classes = materialise(
        rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("vec_id", "label", "embedding")).alias("x"), F.count(F.lit(1)).alias("copies"))
        .select("key", F.col("x.vec_id").alias("cls"), F.col("x.label").alias("label"), F.transform("x.embedding", lambda v: v.cast("double")).alias("v"), "copies"),
        "vector-classes",
    )

    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0  # a number, whatever the vectors

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        for b in batches:
            ids, dims, found = [], [], []
            for cls, v in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                x = v.values.to_numpy().astype(float)
                x = x / np.abs(x).max()
                if len(x) not in codes:
                    some, size, threshold = sized(most, cosine, len(x), parts)
                    codes[len(x)] = (*code(len(x), some, size, seed), threshold)
                got = decode(x / np.linalg.norm(x), *codes[len(x)])
                ids.append(np.full(len(got), cls))
                dims.append(np.full(len(got), len(x), np.int32))
                found.append(got)
            labels = b.column(1).take(pa.array(np.repeat(np.arange(b.num_rows), [len(g) for g in found]).astype(np.int64)))
            empty = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids or empty).astype(np.int64)), labels, pa.array(np.concatenate(dims or empty).astype(np.int32)), pa.array(np.concatenate(found or empty).astype(np.int64))], ["cls", "label", "dim", "filter"])

    kind = vectors.schema["label"].dataType.simpleString()
    posts = classes.select("cls", "label", "v").mapInArrow(filters, f"cls long, label {kind}, dim int, filter long")
    posts = materialise(posts, "vector-filters")
    other = posts.select(F.col("cls").alias("b"), "label", "dim", "filter")
    pairs = posts.withColumnRenamed("cls", "a").join(other, ["label", "dim", "filter"]).filter("a < b").select("a", "b").distinct()

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v = (np.stack([x.values.to_numpy() for x in b.column(k)]) if len({len(x) for x in b.column(k)}) == 1 else None for k in (2, 3))
                if u is None or v is None:
                    near = [float(x @ y / np.sqrt((x @ x) * (y @ y))) >= cosine for x, y in zip((x.values.to_numpy() for x in b.column(2)), (y.values.to_numpy() for y in b.column(3)), strict=True)]
                else:
                    near = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v)) >= cosine
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = classes.select(F.col("cls").alias("a"), F.col("v").alias("u")), classes.select(F.col("cls").alias("b"), "v")
    links = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v").mapInArrow(checked, "a long, b long"), "vector-links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("cls").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("near")).withColumnRenamed("a", "cls")
    named = classes.select("key", "cls", "copies").join(counts, "cls", "left").join(components(links).withColumnRenamed("id", "cls"), "cls", "left")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component", "cls", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("near", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
