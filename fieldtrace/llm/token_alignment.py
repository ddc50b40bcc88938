"""Alignment of two tokenizers over the same bytes, and counts of the id pairs that meet.

Both tokenizers tile a text's bytes, and neither has a token that goes on from a word into a space behind it. So a text
is cut into units, a space with what follows it, and each distinct unit of a chunk is encoded and aligned once. The tokens of both, sorted by start, fall into groups by interval coalescing: a group ends where a start
reaches the greatest end so far. Inside, an A token meets a run of B tokens. Pairs of ids are counted over the corpus
through chunks: a chunk holds each of its pairs once, so the join that brings corpus-wide counts back has a row for a
chunk's pair, not for a document's.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.llm.bpe import _SPACE
from fieldtrace.llm.byte_tokens import ByteTokens, byte_tokens
from fieldtrace.llm.common import NO_ID, materialise, unzipped, zipped

#: Characters of a chunk: it is written as one row, and its pairs are counted together.
CHUNK_CHARS = 6_000_000
#: Characters of texts whose alignments are handed on at a time.
BATCH_CHARS = 500_000
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>, link_first array<int>, link_n array<int>"
CHUNKS = "chunk string, docs binary, shape binary, sha string, lengths binary, units binary, a binary, b binary, held binary, unit_pairs binary, places binary, times binary"
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Pieces:
    """A piece tokenizer that adds a space before a text; its pieces as bytes, a sign for a space and names for bytes."""

    def __init__(self, model: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = self.coder.piece_to_id("▁")
        #: Whether a text may be cut before a space that follows a word: no piece goes on from one into the other.
        self.parts = self.coder.encode("a b", out_type=str) == ["▁a", "▁b"] and not any(re.search(rf"[^{_SPACE}] ", p.replace("▁", " ")) for p in names)

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units that begin with a space; the coder adds that to each by itself, but to an empty one."""
        found = self.coder.encode([u[1:] for u in units], num_threads=1)
        return [ids if len(u) > 1 else [self.space] for u, ids in zip(units, found, strict=True)]


@lru_cache(maxsize=4)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


#: A unit goes from a space to before the next space that follows a word; other white space doesn't end it.
_UNITS = re.compile(rf" [{_SPACE}]*(?:[^{_SPACE}]+(?:[{_SPACE.replace(' ', '')}][{_SPACE}]*)?)*")


def _cuts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and overlaps of two tilings of the same bytes, given the sizes of their tokens.

    Returns the group of every A and of every B token, and for every A token the first B token it overlaps and how many.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)) >= len(a_size), start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    if len(start):
        group[order] = np.concatenate([[0], np.cumsum(start[order][1:] >= reach[:-1])])
    first = np.searchsorted(b_end, a_start, "right")
    return group[: len(a_size)], group[len(a_size) :], first, np.searchsorted(b_start, a_end, "left") - first


@dataclass
class Aligned:
    """Tokens, groups and links of distinct units, one after another; ``n_...`` says how many each unit has."""

    ok: np.ndarray
    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    g_a: np.ndarray
    g_b: np.ndarray
    n_g: np.ndarray
    first: np.ndarray
    n: np.ndarray


def align_units(coder: ByteTokens, pieces: Pieces, units: list[str]) -> Aligned:
    """Encode and align units; one whose bytes either tokenizer does not give back is not ``ok`` and has no tokens."""
    a, b, ok = [], [], np.zeros(len(units), bool)
    a_bytes, b_bytes, none = coder.bytes_of, pieces.bytes_of, []
    for k, (unit, of_b) in enumerate(zip(units, pieces.encode(units), strict=True)):
        of_a, whole = coder.encode(unit, plain=True).tolist(), unit.encode()
        ok[k] = b"".join(map(a_bytes.__getitem__, of_a)) == whole == b"".join(map(b_bytes.__getitem__, of_b))
        a.append(of_a if ok[k] else none)
        b.append(of_b if ok[k] else none)
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    flat_a, flat_b = (np.fromiter((i for ids in x for i in ids), np.int64) for x in (a, b))
    a_len, b_len = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))
    in_a, in_b, first, n = coalesce(a_len[flat_a], b_len[flat_b])
    groups = int(in_a[-1]) + 1 if len(in_a) else 0
    # A unit begins and ends groups of its own: both tilings end there.
    cut = np.concatenate([in_a, [groups]])[_cuts(n_a)] if groups else np.zeros(len(units) + 1, np.int64)
    return Aligned(ok, flat_a, n_a, flat_b, n_b, np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups), np.diff(cut), first - np.repeat(_cuts(n_b)[:-1], n_a), n)


def _taken(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The parts ``which`` of a list of parts, one after another."""
    each = lengths[which]
    ends = np.cumsum(each)
    return flat[np.repeat((_cuts(lengths)[:-1])[which] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Chunk:
    """Documents in order, as places of their units among the distinct ones, and the alignments of those."""

    ids: list
    lengths: np.ndarray
    units: np.ndarray
    aligned: Aligned

    def sums(self, per_unit: np.ndarray) -> np.ndarray:
        """What the units of each document have together; documents with a unit that isn't ok have no units."""
        return np.diff(np.concatenate([[0], np.cumsum(per_unit[self.units])])[_cuts(self.lengths)])


def _chunks(batches: Iterator[pa.RecordBatch], coder: ByteTokens, pieces: Pieces, chars: int) -> Iterator[Chunk]:
    ids, codes, held = [], [], 0
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__

    def flush() -> Chunk:
        aligned = align_units(coder, pieces, list(number))
        kept = [c if aligned.ok[c].all() else c[:0] for c in codes]
        return Chunk(ids, np.array([len(c) for c in kept], np.int64), np.concatenate(kept).astype(np.int64), aligned)

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            found = [] if not text else _UNITS.findall(" " + text) if pieces.parts else [" " + text]
            ids.append(doc)
            codes.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
            held += 100 + len(text or "")
            if held >= chars:
                yield flush()
                ids, codes, held = [], [], 0
                number.clear()
    if ids:
        yield flush()


def _sent(spark: SparkSession, tokenizer: str, pattern: str, model: str) -> Callable[[], tuple[ByteTokens, Pieces]]:
    """Both tokenizers inside a task, of files that the driver has read."""
    sent = spark.sparkContext.broadcast((Path(tokenizer).read_text(encoding="utf-8"), Path(model).read_bytes()))
    return lambda: (byte_tokens(sent.value[0], pattern), _pieces(sent.value[1]))


def align(docs: DataFrame, tokenizer: str, pattern: str, model: str) -> DataFrame:
    """Token ids of both tokenizers, their groups and links, for every row of ``docs``.

    ``doc_id, a_ids, b_ids``; ``group_a, group_b`` (how many A and B tokens each group has, in order); ``link_first,
    link_n`` (for each A token the place of the first B token whose bytes it shares, and how many do). A encodes a space
    and the text, B the text, to which it adds a space; strings of special tokens are plain text. Rows whose text is null
    or empty, and those where either list's bytes aren't the space and the text, have empty arrays. Rows that share a
    ``doc_id`` or have none are aligned each for itself; other columns are ignored; an empty table gives an empty table.
    Both files are read on the driver and sent to the tasks.
    """
    loaded = _sent(docs.sparkSession, tokenizer, pattern, model)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, *loaded(), BATCH_CHARS):
            x, which = c.aligned, c.units
            rows = lambda flat, n: pa.ListArray.from_arrays(pa.array(_cuts(c.sums(n)), pa.int32()), pa.array(_taken(flat, n, which), pa.int32()))  # noqa: B023, E731
            before = np.cumsum(x.n_b[which]) - x.n_b[which] - np.repeat(_cuts(c.sums(x.n_b))[:-1], c.lengths)  # B tokens of the document before a unit
            first = _taken(x.first, x.n_a, which) + np.repeat(before, x.n_a[which])
            links = pa.ListArray.from_arrays(pa.array(_cuts(c.sums(x.n_a)), pa.int32()), pa.array(first, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), rows(x.a, x.n_a), rows(x.b, x.n_b), rows(x.g_a, x.n_g), rows(x.g_b, x.n_g), links, rows(x.n, x.n_a)], ["doc_id", "a_ids", "b_ids", "group_a", "group_b", "link_first", "link_n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(aligned, ALIGNED)


def _written(x: Aligned, a_names: tuple[list[bytes], list[bytes]], b_names: tuple[list[bytes], list[bytes]]) -> list[bytes]:
    """Each unit's groups as text, with a sign after each: A names end in a comma, or a bar at the end of their part of the
    group; B names in a comma, or a semicolon."""
    va, vb = len(a_names[0]), len(b_names[0])
    code_a, code_b = x.a.copy(), x.b + 2 * va
    code_a[np.cumsum(x.g_a) - 1] += va
    code_b[np.cumsum(x.g_b) - 1] += vb
    both = np.empty(len(code_a) + len(code_b), np.int64)
    before = np.cumsum(x.g_a + x.g_b) - (x.g_a + x.g_b)  # where each group begins
    both[np.repeat(before - (np.cumsum(x.g_a) - x.g_a), x.g_a) + np.arange(len(code_a))] = code_a
    both[np.repeat(before + x.g_a - (np.cumsum(x.g_b) - x.g_b), x.g_b) + np.arange(len(code_b))] = code_b
    names = [*a_names[0], *a_names[1], *b_names[0], *b_names[1]]
    parts, cuts = list(map(names.__getitem__, both.tolist())), _cuts(x.n_a + x.n_b).tolist()
    return [b"".join(parts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _distinct_pairs(c: Chunk, unit: np.ndarray, place: np.ndarray, pairs: int) -> np.ndarray:
    """In how many documents of a chunk each pair is; ``unit, place`` say which pairs a unit has."""
    doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
    units = len(c.aligned.n_a)
    once = np.unique(doc * units + c.units)  # a document's units, each once
    doc, which = np.divmod(once, max(1, units))
    per_unit = np.bincount(unit, minlength=units)
    held = np.unique(np.repeat(doc, per_unit[which]) * pairs + _taken(place, per_unit, which))
    return np.bincount(held % max(1, pairs), minlength=pairs)


def _packed_chunks(docs: DataFrame, tokenizer: str, pattern: str, model: str, chunk_chars: int) -> DataFrame:
    """Rows of chunks: digests, counts and units of the documents; the distinct id pairs with how many documents hold each;
    for each unit the places of its pairs among them with how often each is linked."""
    loaded = _sent(docs.sparkSession, tokenizer, pattern, model)
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pieces = loaded()
        a_names, b_names = (tuple([b"%d%s" % (i, sign) for i in range(len(t))] for sign in signs) for t, signs in ((coder.bytes_of, (b",", b"|")), (pieces.bytes_of, (b",", b";"))))
        task = TaskContext.get().partitionId()
        for made, c in enumerate(_chunks(batches, coder, pieces, chunk_chars)):
            x = c.aligned
            # A token's links are a run of B tokens of its unit.
            begins, ends = np.repeat(_cuts(x.n_b)[:-1], x.n_a) + x.first, np.cumsum(x.n)
            at_b = np.repeat(begins - (ends - x.n), x.n) + np.arange(ends[-1] if len(ends) else 0)
            keys = np.repeat(x.a, x.n) << 32 | x.b[at_b]
            unit = np.repeat(np.repeat(np.arange(len(x.n_a)), x.n_a), x.n)
            pairs, place = np.unique(keys, return_inverse=True)
            own, times = np.unique(unit * max(1, len(pairs)) + place, return_counts=True)
            unit, place = np.divmod(own, max(1, len(pairs)))
            links = np.bincount(unit, weights=times, minlength=len(x.n_a)).astype(np.int64)
            shape = np.stack([c.sums(x.n_a), c.sums(x.n_b), c.sums(x.n_g), c.sums(links)], axis=1).reshape(-1)
            written, cuts, codes = _written(x, a_names, b_names), _cuts(c.lengths).tolist(), c.units.tolist()
            sha = [hashlib.sha256(b"".join(map(written.__getitem__, codes[i:j]))[:-1]).hexdigest() if j > i else "-" * 64 for i, j in zip(cuts, cuts[1:], strict=False)]
            values = [
                f"{task}-{made}", zipped(np.array([NO_ID if i is None else i for i in c.ids], "<i8")), zipped(shape.astype("<i8")), "".join(sha), zipped(c.lengths.astype("<u4")), zipped(c.units.astype("<u4"), 3),
                zipped((pairs >> 32).astype("<u4")), zipped((pairs & 0xFFFFFFFF).astype("<u4")), zipped(_distinct_pairs(c, unit, place, len(pairs)).astype("<u4")),
                zipped(np.bincount(unit, minlength=len(x.n_a)).astype("<u4")), zipped(place.astype("<u4")), zipped(times.astype("<u4")),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.binary()) for v in values], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, CHUNKS)


def _pairs(chunks: DataFrame) -> DataFrame:
    """``chunk, place, a, b, held``: the pairs of each chunk."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b, held = (unzipped(r[c], "<u4") for c in ("a", "b", "held"))
                for k in range(0, len(a), 200_000):
                    part = slice(k, k + 200_000)
                    columns = [pa.array(np.arange(len(a))[part], pa.int32()), pa.array(a[part].astype(np.int32)), pa.array(b[part].astype(np.int32)), pa.array(held[part].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]] * len(columns[0])), *columns], ["chunk", "place", "a", "b", "held"])

    return chunks.select("chunk", "a", "b", "held").mapInArrow(unpacked, "chunk string, place int, a int, b int, held long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a, b, n, best``: in how many documents each pair is linked, and whether no pair of its A id is in more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("held").alias("n"))
    return counts.select("a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))


def link_counts(docs: DataFrame, tokenizer: str, pattern: str, model: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``count_sum`` adds up, over a document's links, in how many documents of the corpus the link's id pair is linked;
    ``n_best`` counts links whose pair is the most frequent of its A id, ties included. ``groups_sha256`` digests the
    groups written as ``a1,a2|b1;a3|b2``. Rare inputs as ``align`` has them: rows without tokens are zeros and ''.
    """
    chunks = materialise(_packed_chunks(docs, tokenizer, pattern, model, chunk_chars), "aligned")
    pairs = _pairs(chunks)
    answers = pairs.drop("held").join(pair_counts(pairs), ["a", "b"]).select("chunk", "place", "n", "best")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("place").to_numpy()
        count[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        tables = [pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in names})]
        for r in left.to_pylist():
            lengths, units, per_unit, place, times = (unzipped(r[c], "<u4").astype(np.int64) for c in ("lengths", "units", "unit_pairs", "places", "times"))
            whole = lambda v, cuts: np.diff(np.concatenate([[0], np.cumsum(v)])[_cuts(cuts)])
            sums = [whole(whole(times * v[place], per_unit)[units], lengths) for v in (best, count)]
            sha = [r["sha"][k : k + 64] for k in range(0, len(r["sha"]), 64)]
            columns = [unzipped(r["docs"], "<i8"), *unzipped(r["shape"], "<i8").reshape(-1, 4).T, *sums, ["" if s[0] == "-" else s for s in sha]]
            tables.append(pa.table(dict(zip(names, map(pa.array, columns), strict=True))))
        return pa.concat_tables(tables)

    kept = chunks.select("chunk", "docs", "shape", "sha", "lengths", "units", "unit_pairs", "places", "times")
    kinds = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    found = kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assembled, kinds)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
