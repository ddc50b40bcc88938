"""Best-fit packing of token sequences, with large items matched first.

How many pieces there are of each length decides the packing, and a capacity has only so many lengths. So the tasks count
pieces by length, the driver packs the counts, and every piece finds its own place by its number among those of its
length. No task sees more than its own pieces, and only counts by length reach the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.byte_tokens import byte_tokens
from fieldtrace.llm.common import materialise

CAPACITY = 1024
#: Tokens that a task gathers before it hands rows on.
_HELD = 1_000_000


def cut(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of encoded documents: ``doc_id, piece, start, length, ids array<int>, part, nth``.

    A document is its ids and then ``end_id``; null and empty texts are ``end_id`` alone. Only documents of more than
    ``capacity`` ids are cut: all pieces are ``capacity`` long but the first, which takes what is left over. Rows that
    share a ``doc_id`` or have none are documents of their own; other columns are ignored; an empty table gives an empty
    table. ``part`` is the task and ``nth`` the number among its pieces of that length, both of the run that wrote them:
    write the table before use. ``tokenizer`` is the path of a byte-level BPE file, read on the driver.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = byte_tokens(sent.value, pattern), TaskContext.get().partitionId()
        seen, docs_, encoded, held = np.zeros(capacity + 1, np.int64), [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(x) for x in encoded], np.int64)
            each = -(-n // capacity)
            last = np.cumsum(each)
            piece = np.arange(last[-1]) - np.repeat(last - each, each)
            first = np.repeat(n - (each - 1) * capacity, each)
            length = np.where(piece == 0, first, capacity)
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            order = np.argsort(length, kind="stable")
            run = length[order]
            nth = np.empty_like(length)
            nth[order] = seen[run] + np.arange(len(run)) - np.searchsorted(run, run)
            np.add.at(seen, length, 1)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(encoded).astype(np.int32)))
            whose = pa.array(docs_, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), each)))
            return pa.RecordBatch.from_arrays([whose, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids, pa.array(np.full(len(piece), part, np.int32)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs_.append(doc)
                encoded.append(np.append(coder.encode(text.as_py() or ""), np.uint32(end_id)))
                held += len(encoded[-1])
                if held >= _HELD:
                    yield flush()
                    docs_, encoded, held = [], [], 0
        if encoded:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids array<int>, part int, nth long")


@dataclass(frozen=True)
class Run:
    """``each`` pieces of one length in every sequence from ``base`` on, from ``offset``; the first is number ``low`` of its length."""

    length: int
    low: int
    each: int
    base: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Pack ``counts`` (pieces by length) into sequences of at most ``capacity`` tokens.

    Pieces above a third of the capacity, of which no sequence holds three, are matched: the longest left takes the
    longest that still fits beside it, which leaves the fewest sequences. Shorter ones, longest first, go where they
    leave the smallest gap, and open a sequence where no gap takes them. All pieces of a length move at once, so the work
    depends on the capacity, not on the number of pieces.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is outside 1..capacity")
    placed, runs, made = dict.fromkeys(left, 0), [], 0
    gaps: dict[int, list[list[int]]] = {}  # gap: ranges of sequences that have it, as [first, how many]
    order: list[int] = []

    def put(length: int, n: int, each: int, base: int, offset: int) -> None:
        runs.append(Run(length, placed[length], each, base, offset))
        placed[length] += n
        left[length] -= n

    def leave(gap: int, base: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append([base, n])

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            b = next((k for k in reversed(large[: bisect_right(large, capacity - a)]) if left[k] > (k == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, 1, made, 0)
            if b is not None:
                put(b, n, 1, made, a)
            leave(capacity - a - (b or 0), made, n)
            made += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at < len(order):
                gap = order[at]
                base, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, base, n = capacity, made, -(-left[s] // (capacity // s))
                made += n
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, each, base, capacity - gap)
                leave(gap - each * s, base, full)
            if full < n and left[s] and left[s] < each:  # the last of this length share one more sequence
                some = left[s]
                put(s, some, some, base + full, capacity - gap)
                leave(gap - some * s, base + full, 1)
                full += 1
            leave(gap, base + full, n - full)
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to a written table of pieces with ``part, nth, length``, and drop ``part, nth``.

    The plan that is sent to the tasks has at most a few rows for each length and gap of the capacity.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(total, capacity), key=lambda r: (r.length, r.low))
    table = np.array([(r.length, r.low, r.each, r.base, r.offset) for r in runs], np.int64).reshape(-1, 5)
    # Places of runs in one order: a length's runs begin where `first` says, and `low` rises among them.
    sent = spark.sparkContext.broadcast((table, np.searchsorted(table[:, 0], np.arange(capacity + 2))))
    wanted = [f for f in pieces.schema.fields if f.name not in ("part", "nth")]
    names = [f.name for f in wanted]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = sent.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            low, high = first[length], first[length + 1]
            while (high - low > 1).any():  # the last run of the length that begins at the rank or before it
                middle = (low + high) // 2
                below = table[middle, 1] <= rank
                low, high = np.where(below, middle, low), np.where(below, high, middle)
            at, k = table[low], rank - table[low, 1]
            sequence, offset = at[:, 3] + k // at[:, 2], at[:, 4] + k % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(counts.select("part", "length", "before"), ["part", "length"]).select(*names, (F.col("before") + F.col("nth")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of every piece of ``docs``; rare inputs as ``cut`` has them."""
    return place(materialise(cut(docs, tokenizer, pattern, end_id, capacity), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets``: the sequences themselves, at most a capacity of ids each."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_p"))
    return rows.select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.offset").alias("offsets"))


def with_crc(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``: the unsigned checksum of the ids as little-endian unsigned 32-bit integers."""
    kept = [f for f in pieces.schema.fields if f.name != "ids"]
    names = [f.name for f in kept]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return pieces.mapInArrow(summed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", ids_crc32 long")
