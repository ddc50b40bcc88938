"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

Texts are gathered into chunks. A chunk lists its pre-tokens by position as numbers of its own distinct words, and sends
each distinct word once to the bucket of its hash. A bucket merges what all chunks sent, encodes each distinct
word once, and answers every chunk in the order asked. The chunk then puts ids in place of word numbers, in order of
position. So a word that fills the corpus costs one entry a chunk, and no dictionary is sent to all tasks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.common import NO_ID, shuffle_partitions, unzipped, zipped

CHUNK_CHARS = 6_000_000
#: The characters of Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A coarser cut: a word with the space before it, or white space. Pre-tokens of the usual patterns never cross it.
PIECES = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: merged away
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], "<u4")
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(words))


def _unpack_words(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


CHUNKS = "chunk string, bucket int, n int, words binary, docs binary, lengths binary, tokens binary"


def _chunks(docs: DataFrame, pattern: str, pieces: str, buckets: int, chunk_chars: int) -> DataFrame:
    """Chunks of texts, cut into pre-tokens.

    For each chunk a row for each bucket that it asks, with its ``words``, and one with bucket -1: the numbers of its
    pre-tokens by position, and in ``words`` where each number's answer will be.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, fine = re.compile(pieces).findall, regex.compile(pattern).findall
        task, made = TaskContext.get().partitionId(), 0
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        ids, lengths, tokens, chars = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, chars
            if not ids:
                return
            index: defaultdict = defaultdict()
            index.default_factory = index.__len__
            flat, sizes = [], []
            for piece in number:  # the fine pattern cuts each distinct piece once
                got = fine(piece)
                sizes.append(len(got))
                flat.extend(map(index.__getitem__, got))
            words = [w.encode("utf-8", "surrogatepass") for w in index]
            bucket = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int32) if words else np.empty(0, np.int32)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)  # answers come in this order
            stream, each = np.concatenate(tokens).astype(np.int64), np.array(sizes, np.int64)
            begin, ends = np.cumsum(each) - each, np.cumsum(each[stream])
            cut_at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
            stream = np.array(flat, "<u4")[np.repeat(begin[stream] - (ends - each[stream]), each[stream]) + np.arange(cut_at[-1])]
            rows = [(-1, len(words), zipped(place, 3), zipped(np.array(ids, "<i8"), 3), zipped(np.diff(cut_at).astype("<u4"), 3), zipped(stream, 3))]
            used, starts = np.unique(bucket[order], return_index=True)
            for k, a, b in zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(words)][: len(used)], strict=True):
                rows.append((k, b - a, _pack_words([words[j] for j in order[a:b].tolist()]), b"", b"", b""))
            # The name tells the content: a task that is run again over rows in another order makes chunks of other names,
            # and never meets the answers to its first run.
            mark = hashlib.blake2b(digest_size=12)
            for r in rows:
                mark.update(b"%d," % r[1] + b"".join(r[2:]))
            name = f"{task}-{made}-{mark.hexdigest()}"
            made += 1
            yield pa.RecordBatch.from_pydict({"chunk": [name] * len(rows), "bucket": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int32()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("words", "docs", "lengths", "tokens"), 2)}})
            number.clear()
            ids.clear(), lengths.clear(), tokens.clear()
            chars = 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                found = find(text)
                tokens.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
                ids.append(NO_ID if doc is None else doc)
                lengths.append(len(found))
                chars += len(text) + 1
                if chars >= chunk_chars:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, CHUNKS)


def encode(docs: DataFrame, ranks_path: str, pattern: str, pieces: str = PIECES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, ids array<int>`` of every row of ``docs``.

    Ids are those of the ranks, each match of ``pattern`` by itself, no special tokens; no match of ``pattern`` may
    cross the matches of ``pieces``, which are cut first. Null and empty texts have no
    ids. Repeated rows, and rows that share a ``doc_id`` or have none, are encoded each for itself. An empty table gives an
    empty table. Other columns are ignored. ``ranks_path`` is read on the driver and sent to the tasks: its size is that
    of the vocabulary.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load_ranks(ranks_path))
    buckets = shuffle_partitions(spark)
    # One shuffle by chunk serves both: what the buckets are asked, and the texts that wait there for the answers.
    chunks = _chunks(docs, pattern, pieces, buckets, chunk_chars).repartition(buckets, "chunk")

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.greater_equal(b.column("bucket"), 0)).select(["chunk", "bucket", "n", "words"])

    def answer(asked: pa.Table) -> pa.Table:
        ranks, known, rows = sent.value, {}, asked.to_pylist()  # known: the distinct words of one bucket
        sizes, found = [], []
        for r in rows:
            out = []
            for w in _unpack_words(r["words"], r["n"]):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(encode_word(w, ranks), "<u4").tobytes()
                out.append(ids)
            sizes.append(zipped(np.array([len(x) // 4 for x in out], "<u4"), 3))
            found.append(zipped(np.frombuffer(b"".join(out), "<u4"), 3))
        return pa.table({"chunk": [r["chunk"] for r in rows], "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(found, pa.binary())})

    # Rows are chosen inside functions: a filter would be pushed below the shuffle, and texts cut a second time.
    asked = chunks.mapInArrow(questions, "chunk string, bucket int, n int, words binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk string, bucket int, sizes binary, ids binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        sizes = np.concatenate([np.empty(0, np.uint32), *(unzipped(x.as_py(), "<u4") for x in right.column("sizes"))]).astype(np.int64)
        flat = np.concatenate([np.empty(0, np.uint32), *(unzipped(x.as_py(), "<u4") for x in right.column("ids"))])
        starts = np.cumsum(sizes) - sizes
        tables = []
        for r in left.filter(pc.equal(left.column("bucket"), -1)).to_pylist():
            if len(sizes) != r["n"]:
                raise ValueError("a chunk and the answers to it differ: a task was run again over rows in another order")
            docs_, lengths = unzipped(r["docs"], "<i8"), unzipped(r["lengths"], "<u4")
            tokens = unzipped(r["words"], "<u4")[unzipped(r["tokens"], "<u4")].astype(np.int64)
            each = sizes[tokens]
            ends = np.cumsum(each)
            ids = flat[np.repeat(starts[tokens] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32)
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])].astype(np.int32)
            tables.append(pa.table({"doc_id": pa.array(docs_, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))}))
        return pa.concat_tables(tables) if tables else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})

    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, "doc_id long, ids array<int>")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _token_bytes(spark: SparkSession, ranks_path: str) -> Broadcast:
    """The token-byte table of a vocabulary, by id: its size is that of the vocabulary, whatever the texts."""
    table = {i: token for token, i in load_ranks(ranks_path).items()}
    return spark.sparkContext.broadcast([table.get(i) for i in range(max(table) + 1)])


def _joined(tokens: list[bytes], ids: pa.ListScalar) -> bytes:
    """The bytes of a list of ids, each looked up in the token-byte table."""
    return b"".join(map(tokens.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else b""


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded binary``: the bytes of the ids, joined from the token-byte table of the vocabulary.

    The join is a broadcast one by position: the table is a list, and an id is a place in it. Null id lists decode to
    no bytes; an id that the vocabulary lacks is an error.
    """
    sent, at = _token_bytes(encoded.sparkSession, ranks_path), encoded.columns.index("ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_joined(tokens, x) for x in part.column(at)], pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(decoded, _schema(encoded) + ", decoded binary")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded texts, decoded as ``decode`` does.

    Ids count as little-endian unsigned 32-bit integers. Decoding and digests are one pass, so decoded bytes stay in
    the task.
    """
    sent = _token_bytes(encoded.sparkSession, ranks_path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sent.value
        for b in batches:
            sizes, ids, decoded = [], [], []
            for x in b.column(1):
                raw = x.values.to_numpy().astype("<u4").tobytes() if x.is_valid else b""
                sizes.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(_joined(tokens, x)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
