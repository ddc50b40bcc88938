"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import fold

BITS = 18
TRAIN_DOCS = 4000
EPOCHS = 3

_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalnum() or c >= 128)
_CASES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(tokens: list[bytes], salt: int) -> np.ndarray:
    if not tokens:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False) + np.uint64(salt) * _MIX
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xD6E8FEB86659FD93)


def slots(text: str | None, bits: int = BITS) -> np.ndarray:
    """Feature slots of a text, one for each occurrence; slot 0 is the bias.

    Words and word pairs in lower case; the words that are left when letters and digits go (runs of symbols); pairs
    of word shapes (the case of the first two characters); and a mark for each word that repeats the one before it.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = _hashes(raw.lower().split(), 1)
    symbols = _hashes(raw.translate(None, _LETTERS).split(), 2)
    shapes = _hashes([s[:2] for s in raw.translate(_CASES).split()], 3)
    parts = [w, symbols, shapes]
    with np.errstate(over="ignore"):
        for h in (w, shapes):
            if len(h) > 1:
                parts.append((h[:-1] * np.uint64(3) + h[1:]) * _MIX)
        parts.append(np.full(int((w[1:] == w[:-1]).sum()), 0x5BD1E9955BD1E995, np.uint64))
    found = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.maximum(found, 1)])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates over (slots, values, label), in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, label in rows:
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(1 << bits)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, bits: int = BITS, seed: int = 6, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from at most ``train_docs`` labelled documents outside the held-out fold.

    The bound is the only limit on the rows: those with the lowest seeded hashes of their ids. Rows without an id, a
    label or a document don't count; a label that repeats counts once (the highest). Without any, weights are 0.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id").agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(train_docs)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                s = slots(text.as_py(), bits)
                i, c = np.unique(s, return_counts=True)
                x = (c / np.sqrt(len(s))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([label], pa.int32()), pa.array([i.astype(np.uint32).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["doc_id", "label", "i", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int"))
    found = rows.mapInArrow(extract, "doc_id long, label int, i binary, x binary").toArrow().to_pylist()
    found.sort(key=lambda r: (pd.util.hash_array(np.array([r["doc_id"] ^ seed]))[0], r["i"]))
    return ftrl([(np.frombuffer(r["i"], np.uint32), np.frombuffer(r["x"], np.float32).astype(float), r["label"]) for r in found], bits, epochs)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """``doc_id, score`` of every row: the sparse dot product of its features with the weights, as a chance.

    The weights (2 ** bits floats) are all that is sent to the tasks. Null and empty texts get the bias alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            out = np.empty(b.num_rows)
            for k, text in enumerate(b.column(1)):
                s = slots(text.as_py(), bits)
                out[k] = w[s].sum(dtype=np.float64) / np.sqrt(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from ``labels`` outside the fold crc32(doc_id) mod 3 = 1; neither labels nor lang, source or id enter a
    score. Null and empty texts are scored by the bias. Repeated rows come out as often as they come in;
    rows without an id are scored and never held out.
    """
    scored = score(docs, train(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bits: int = BITS, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bits=bits, **options))
    column = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            good = []
            for text in b.column(column):
                s = slots(text.as_py(), bits)
                good.append(1.0 / (1.0 + np.exp(-w[s].sum(dtype=np.float64) / np.sqrt(len(s)))) >= threshold)
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
