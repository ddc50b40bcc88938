"""Exact substring dedup by suffix arrays over shards of contexts.

A window of ``length`` bytes always holds an anchor: the k-gram with the lowest hash among its k-grams, the leftmost of
equals. Equal windows have equal anchors. Consecutive windows with one anchor are a run, and the bytes that a run covers
are its context; each window belongs to one run.

Texts are packed into chunks. A chunk asks hash buckets, each distinct anchor once, which of its anchors a second
document holds. The contexts of those, each distinct one once a chunk with the lowest document that holds it, go to the
shard of the anchor's hash. A shard builds the suffix array of its distinct contexts by induced sorting; permuted
common prefixes, cut at ``length``, part it into runs of equal windows, and the lowest document of each such run tells
which windows begin in a smaller document. Chunks get one mask back for each context that they sent.

What goes over the network is bounded by distinct anchors and contexts of chunks: a passage that fills the corpus costs
one entry a chunk, and nothing is gathered on the driver or sent to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import NO_ID, materialise, pack, shuffle_partitions, unzipped, zipped

LENGTH, ANCHOR = 50, 16
CHUNK_BYTES = 4_000_000
#: Shards for each shuffle partition: a task builds its suffix arrays one after the other.
SHARDS = 12
#: Windows are found block by block, so that a block's hashes stay in the processor's cache.
_BLOCK = 1 << 16
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def induced(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` (numbers up to 255, 0 lowest), exact in the first ``depth`` places.

    Suffixes are classed as smaller or larger than the next one; the leftmost-smaller substrings are sorted by
    induction and named; the string of names is sorted; two linear passes induce the whole array. Each pass goes bucket
    by bucket with whole runs at a time. The string of names has too many letters for buckets and is sorted by
    doubling; a name covers two places at least, so half of ``depth`` names decide.
    """
    n = len(text)
    t = np.append(text.astype(np.uint16) + np.uint16(1), np.uint16(0))
    step = np.sign(t[1:].astype(np.int32) - t[:-1]).astype(np.int8)
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(np.append(step, np.int8(-1))[nearest] > 0, True)  # the suffix is smaller than the next one
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + np.int32(1)
    size = int(t.max()) + 1
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    used = np.flatnonzero(counts).tolist()
    larger_before, smaller_before = np.append(False, ~smaller[:-1]), np.append(False, smaller[:-1])

    def induce(order: np.ndarray) -> np.ndarray:
        sa = np.full(n + 1, -1, np.int32)
        letters = t[order]
        held = np.bincount(letters, minlength=size)
        by = np.argsort(letters, kind="stable")
        place = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        sa[np.repeat(ends - held, held) + place] = order[by]
        head = starts.copy()

        def put(j: np.ndarray, heads: np.ndarray, sign: int) -> None:
            c = t[j]
            k = np.argsort(c, kind="stable")
            much = np.bincount(c, minlength=size)
            got = np.flatnonzero(much)
            m = much[got]
            first = np.cumsum(m) - m
            if sign > 0:
                sa[np.repeat(heads[got] - first, m) + np.arange(len(j))] = j[k]
            else:
                sa[np.repeat(heads[got] - 1 + first, m) - np.arange(len(j))] = j[k]
            heads += sign * much

        for c in used:
            i = starts[c]
            while i < head[c]:
                seg = sa[i : head[c]]
                i = head[c]
                j = seg[larger_before[seg]] - 1
                if len(j):
                    put(j, head, 1)
            seg = sa[ends[c] - held[c] : ends[c]]
            j = seg[larger_before[seg]] - 1
            if len(j):
                put(j, head, 1)
        sa[0] = n  # the smaller suffixes are placed anew, from the right
        tail = ends.copy()
        for c in used[::-1]:
            i = ends[c]
            while i > tail[c]:
                seg = sa[tail[c] : i][::-1]
                i = tail[c]
                j = seg[smaller_before[seg]] - 1
                if len(j):
                    put(j, tail, -1)
            seg = sa[starts[c] : head[c]][::-1]
            j = seg[smaller_before[seg]] - 1
            if len(j):
                put(j, tail, -1)
        return sa

    if len(lms) > 1:
        sa = induce(lms)
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        rank = np.zeros(n + 1, np.int32)
        rank[lms] = np.arange(len(lms), dtype=np.int32)
        size_of = np.append(np.diff(lms), 1).astype(np.int32)[rank[order]]
        both = (t << np.uint16(1)) | smaller
        same = np.append(False, size_of[1:] == size_of[:-1])
        live = np.flatnonzero(same)
        for k in range(int(size_of.max()) + 1):
            if not len(live):
                break
            live = live[k <= size_of[live]]
            a, b = np.minimum(order[live] + k, n), np.minimum(order[live - 1] + k, n)
            equal = both[a] == both[b]
            same[live[~equal]] = False
            live = live[equal]
        names = np.empty(len(lms), np.int64)
        names[rank[order]] = np.cumsum(~same) - 1
        reach = 1
        while 2 * reach < depth and names.max() + 1 < len(names):
            key = (names << np.int64(32)) | np.append(names[reach:] + 1, np.zeros(min(reach, len(names)), np.int64))[: len(names)]
            o = np.argsort(key)
            s = key[o]
            names = np.empty(len(lms), np.int64)
            names[o] = np.cumsum(np.append(False, s[1:] != s[:-1]))
            reach *= 2
        lms = lms[np.argsort(names)]
    return induce(lms)[1:]


def _words(b: np.ndarray) -> np.ndarray:
    """A view of the eight bytes that begin at each position, as one number (bytes beyond the end count as 0)."""
    return np.ndarray((len(b),), "<u8", np.append(b, np.zeros(8, np.uint8)), strides=(1,))


def equal_windows(text: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """A class number for each window start in ``begins`` (ascending): equal for equal windows.

    From the suffix array of the text and its permuted common prefixes, cut at ``length`` and compared eight bytes at a
    time.
    """
    sa = induced(text, length)
    wanted = np.zeros(len(text), bool)
    wanted[begins] = True
    order = sa[wanted[sa]]
    w = _words(text)
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]  # the window before each one, in text order
    p, q = begins, before[begins]
    full = np.flatnonzero(q >= 0)
    for k in [*range(0, length - 7, 8), length - 8]:
        full = full[w[p[full] + k] == w[q[full] + k]]
    shared = np.zeros(len(text), bool)
    shared[begins[full]] = True
    number = np.empty(len(text), np.int32)
    number[order] = np.cumsum(~shared[order]) - 1
    return number[begins]


def _grams(text: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams (k a power of two)."""
    with np.errstate(over="ignore"):
        h = (text.astype(np.uint64) + np.uint64(1)) * _M
        h ^= h >> np.uint64(32)
        width = 1
        while width < k:
            h = h[: len(h) - width] * _P + (h[width:] ^ (h[width:] >> np.uint64(29))) * _M
            h ^= h >> np.uint64(31)
            width *= 2
    return h


def runs(raw: np.ndarray, begin: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, 48-bit hash of the anchor.

    ``raw`` holds documents end to end, ``begin`` where each begins and the end; windows that cross documents don't count.
    """
    n, low = len(raw) - length + 1, np.uint64(0xFFFFF)
    inside = np.ones(max(n, 0), bool)
    for e in begin[1:-1].tolist():
        inside[max(e - length + 1, 0) : e] = False
    starts, ranks, grams, valid, last = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0, -1
    for a in range(0, n, _BLOCK):
        b = min(a + _BLOCK, n)
        h = _grams(raw[a : b + length - 1], k)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the place in the low bits: the leftmost of equals
        done, span = 1, length - k + 1
        while done < span:
            by = min(done, span - done)
            least = np.minimum(least[: len(least) - by], least[by:])
            done += by
        at = np.where(inside[a:b], (least & low).astype(np.int64) + a, -1)
        new = np.flatnonzero((at != np.append(last, at[:-1])) & (at >= 0))
        rank = np.cumsum(at >= 0)
        starts.append(new + a)
        ranks.append(valid + rank[new] - 1)
        grams.append(h[at[new] - a])
        valid, last = valid + int(rank[-1]), at[-1]
    gram = np.concatenate(grams)
    with np.errstate(over="ignore"):  # the lowest hashes were chosen: mixed anew, they spread over buckets and shards
        gram = (gram ^ (gram >> np.uint64(31))) * _P
        gram = (gram ^ (gram >> np.uint64(29))) * _M
    return np.concatenate(starts), np.diff(np.append(np.concatenate(ranks), valid)), gram >> np.uint64(16)


def _prints(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings that begin at ``starts``, eight bytes at a time."""
    words, h = _words(text), sizes.astype(np.uint64) * _P
    with np.errstate(over="ignore"):
        for k in range(0, int(sizes.max(initial=0)), 8):
            live = np.flatnonzero(sizes > k)
            beyond = np.maximum(8 - (sizes[live] - k), 0).astype(np.uint64) * np.uint64(8)
            x = (h[live] ^ ((words[starts[live] + k] << beyond) >> beyond)) * _M
            h[live] = (x ^ (x >> np.uint64(29))) * _P
        return h ^ (h >> np.uint64(32))


def _gathered(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The strings that begin at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    return text[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Chunk:
    """A chunk's texts and their runs; ``found`` are its distinct anchors, in order, ``inverse`` the place of each run's anchor there."""

    def __init__(self, row: dict, length: int, k: int):
        self.ids, self.length = unzipped(row["ids"], "<i8"), length
        self.begin = np.concatenate([[0], np.cumsum(unzipped(row["sizes"], "<u4").astype(np.int64))])
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        self.start, self.windows, self.gram = runs(self.raw, self.begin, length, k)
        self.owner = self.ids[np.searchsorted(self.begin, self.start, side="right") - 1]
        self.found, self.inverse = np.unique(self.gram, return_inverse=True)

    def cuts(self, buckets: int) -> np.ndarray:
        return np.searchsorted(self.found, np.array([(b << 48) // buckets for b in range(buckets)] + [1 << 48], np.uint64))

    def often(self) -> np.ndarray:
        """Whether two documents of the chunk hold an anchor."""
        order = np.argsort(self.inverse, kind="stable")
        owner, edges = self.owner[order], np.searchsorted(self.inverse[order], np.arange(len(self.found)))
        return np.minimum.reduceat(owner, edges) != np.maximum.reduceat(owner, edges) if len(owner) else np.empty(0, bool)

    def keep(self, shared: np.ndarray, shards: int) -> None:
        """Contexts of the shared anchors, each distinct one once, in the order of shards: ``which`` run is the first, ``lowest`` document, ``shard``; ``context`` of each hit."""
        if len(shared) != len(self.found):
            raise ValueError("a chunk and the answers to it differ")
        self.hits = np.flatnonzero(shared[self.inverse])
        sizes = self.windows[self.hits] + self.length - 1
        _, first, context = np.unique(_prints(self.raw, self.start[self.hits], sizes), return_index=True, return_inverse=True)
        shard = (((self.gram[self.hits[first]] >> np.uint64(16)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which, self.shard, self.context = self.hits[first[order]], shard[order], place[context]
        self.lowest = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(self.lowest, self.context, self.owner[self.hits])


def _shared(answers: list[dict]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in sorted(answers, key=lambda r: r["part"])]
    return np.concatenate([np.empty(0, np.uint8), *parts]).astype(bool)


def removed_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans array<array<int>>, kept binary`` of every row of ``docs``.

    Each byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id goes; strings
    are judged on the input and never cross documents. Texts count as UTF-8 bytes, null as empty; other columns are
    ignored. ``spans`` are the maximal removed runs (begin, end). Rows that share a doc_id are the same document: what
    one of them repeats of the other stays, and what a smaller document holds goes from both. Rows without an id are one
    document, lower than all. An empty table gives an empty table. ``length`` is 2 to 63 more than ``anchor``, a power of
    two. Contexts of one chunk or shard are told apart by length and 64-bit hash, windows by their bytes.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    shards = SHARDS * buckets
    chunks = materialise(pack(docs, chunk_bytes), "suffix-chunks")

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                chunk = _Chunk(row, length, anchor)
                cuts, many = chunk.cuts(buckets), chunk.often()
                parts = [(k, x, y) for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([row["chunk"]] * len(parts), pa.string()), "bucket": pa.array([k for k, _, _ in parts], pa.int32()), "n": pa.array([y - x for _, x, y in parts], pa.int32()),
                    "steps": pa.array([zipped(np.diff(chunk.found[x:y], prepend=np.uint64(0)).astype("<u8")) for _, x, y in parts], pa.binary()), "many": pa.array([np.packbits(many[x:y]).tobytes() for _, x, y in parts], pa.binary()),
                })

    def answer(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        parts = [np.cumsum(unzipped(r["steps"], "<u8"), dtype=np.uint64) for r in rows]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=r["n"]) for r in rows])
        found, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        # an anchor is shared if two chunks hold it, or two documents of one
        shared = np.bincount(inverse, minlength=len(found)) + np.bincount(inverse, weights=many, minlength=len(found)) > 1
        ends = np.cumsum([len(p) for p in parts]).tolist()
        bits = [np.packbits(shared[inverse[x:y]]).tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.string()), "part": pa.array([r["bucket"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int32()), "bits": pa.array(bits, pa.binary())})

    asked = chunks.mapInArrow(ask, "chunk string, bucket int, n int, steps binary, many binary")
    known = materialise(asked.groupBy("bucket").applyInArrow(answer, "chunk string, part int, n int, bits binary"), "suffix-anchors")

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"chunk": [], "shard": [], "windows": [], "lowest": [], "texts": []}
        for row in left.to_pylist():
            chunk = _Chunk(row, length, anchor)
            chunk.keep(_shared(right.to_pylist()), shards)
            windows, starts = chunk.windows[chunk.which], chunk.start[chunk.which]
            at, first = np.unique(chunk.shard, return_index=True)
            edges = np.append(first, len(chunk.shard)).tolist()
            for shard, x, y in zip(at.tolist(), edges[:-1], edges[1:], strict=True):
                out["chunk"].append(row["chunk"])
                out["shard"].append(shard)
                out["windows"].append(zipped(windows[x:y].astype("<u1")))
                out["lowest"].append(zipped(chunk.lowest[x:y].astype("<i8")))
                out["texts"].append(zipped(_gathered(chunk.raw, starts[x:y], windows[x:y] + length - 1)))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    def decide(sent: pa.Table) -> pa.Table:
        rows = sent.select(["chunk", "shard"]).to_pylist()
        part = lambda c, kind: [unzipped(x.as_py(), kind) for x in sent.column(c)]
        windows, lowest = part("windows", "<u1"), np.concatenate(part("lowest", "<i8"))
        ends = np.cumsum([len(x) for x in windows]).tolist()
        windows = np.concatenate(windows).astype(np.int64)
        text, sizes = np.concatenate(part("texts", "u1")), windows + length - 1
        starts = np.cumsum(sizes) - sizes
        _, first, context = np.unique(_prints(text, starts, sizes), return_index=True, return_inverse=True)
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, context, lowest)
        text, windows_of = _gathered(text, starts[first], sizes[first]), windows[first]
        cut = np.cumsum(windows_of) - windows_of
        which = np.repeat(np.arange(len(first)), windows_of)
        offset = np.arange(len(which)) - cut[which]
        equal = equal_windows(text, (np.cumsum(sizes[first]) - sizes[first])[which] + offset, length)
        least = np.full(int(equal.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, equal, low[which])
        bits = np.add.reduceat((least[equal] < low[which]).astype(np.int64) << offset, cut)
        # A chunk whose lowest document isn't the lowest of the context loses every window of it.
        mask = np.where(lowest > low[context], (np.int64(1) << windows) - 1, bits[context])
        masks = [zipped(mask[x:y].astype("<i8")) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.string()), "part": pa.array([r["shard"] for r in rows], pa.int32()), "n": pa.array([-1] * len(rows), pa.int32()), "bits": pa.array(masks, pa.binary())})

    by_chunk = chunks.groupBy("chunk")
    sent = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(contexts, "chunk string, shard int, windows binary, lowest binary, texts binary")
    decided = sent.groupBy("shard").applyInArrow(decide, "chunk string, part int, n int, bits binary")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, answers = [], right.to_pylist()
        for row in left.to_pylist():
            chunk = _Chunk(row, length, anchor)
            chunk.keep(_shared([r for r in answers if r["n"] >= 0]), shards)
            masks = np.concatenate([np.empty(0, np.int64), *(unzipped(r["bits"], "<i8") for r in sorted((r for r in answers if r["n"] < 0), key=lambda r: r["part"]))])
            if len(masks) != len(chunk.which):
                raise ValueError("a chunk and the answers to it differ")
            # Within the chunk, documents above the lowest that holds a context lose all of it.
            mask = np.where(chunk.owner[chunk.hits] > chunk.lowest[chunk.context], (np.int64(1) << chunk.windows[chunk.hits]) - 1, masks[chunk.context])
            size, gone = len(chunk.raw), np.zeros(len(chunk.raw) + 1, np.int16)
            for bit in range(length - anchor + 1):
                at = chunk.start[chunk.hits[(mask >> bit) & 1 == 1]] + bit
                gone[at] += 1
                gone[at + length] -= 1
            hole = np.cumsum(gone[:-1], dtype=np.int16) > 0
            edge = hole.copy()
            edge[1:] &= ~hole[:-1]
            inner = chunk.begin[:-1][chunk.begin[:-1] < size]
            edge[inner] = hole[inner]
            stop = hole.copy()
            stop[:-1] &= ~hole[1:]
            last = chunk.begin[1:][chunk.begin[1:] > 0] - 1
            stop[last] = hole[last]
            x, y = np.flatnonzero(edge), np.flatnonzero(stop) + 1
            doc = np.searchsorted(chunk.begin, x, side="right") - 1
            spans = np.column_stack([x, y]) - chunk.begin[doc][:, None]
            n_spans = np.bincount(doc, minlength=len(chunk.ids))
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 2), pa.array(spans.reshape(-1).astype(np.int32)))
            total = np.append(np.int32(0), np.cumsum(hole, dtype=np.int32))
            removed = total[chunk.begin[1:]] - total[chunk.begin[:-1]]
            kept, left_at = chunk.raw[~hole].tobytes(), (chunk.begin - total[chunk.begin]).tolist()
            tables.append(pa.table({
                "doc_id": pa.array(chunk.ids), "n_bytes": pa.array(np.diff(chunk.begin)), "n_removed": pa.array(removed.astype(np.int64)),
                "spans": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), pairs), "kept": pa.array([kept[a:b] for a, b in zip(left_at[:-1], left_at[1:], strict=True)], pa.binary()),
            }))
        return pa.concat_tables(tables)

    answers = known.unionByName(decided)
    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def digests(cut: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
