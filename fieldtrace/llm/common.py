"""What the corpus operators share: words, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: list[str] = []
_written: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on this machine alone."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not (spark.sparkContext.master.split("[")[0] == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="fieldtrace-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return "file://" + _own_scratch[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many tables ``materialise`` has written and not dropped."""
    return len(_written)


def drop_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``materialise`` has written after the first ``since``, but the last ``keep``; results that read them are lost."""
    gone = _written[since : len(_written) - keep]
    for name in gone:
        _written.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stands for a null id in packed rows: lower than any id.
NO_ID = -(2**63)


def zipped(a: np.ndarray, level: int = 1) -> bytes:
    """Bytes of an array, plane after plane, compressed: the empty high bytes of small numbers vanish."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def unzipped(b: bytes, dtype: str) -> np.ndarray:
    if not b:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Texts in chunks of about ``chunk_bytes``: ``chunk, ids, sizes, texts`` (null texts as empty, null ids as NO_ID)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_pydict({"chunk": [f"{task}-{made}"], "ids": pa.array([zipped(np.array(ids, "<i8"))], pa.binary()), "sizes": pa.array([zipped(np.array([len(t) for t in texts], "<u4"))], pa.binary()), "texts": pa.array([blob], pa.binary())})

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                ids.append(NO_ID if doc is None else doc)
                texts.append(text.as_py() or b"")
                held += len(texts[-1]) + 8
                if held >= chunk_bytes:
                    yield row()
                    made, ids, texts, held = made + 1, [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, "chunk string, ids binary, sizes binary, texts binary")
