"""A corpus pipeline over the documents table: five stages, each written as Parquet and read again by the next.

Every stage takes an empty table to an empty table, and passes other columns on, whatever their names; only the last
returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldtrace.llm import line_dedup, mixing, ngram_join, quality_classifier
from fieldtrace.llm.common import drop_scratch, materialise, read_table, written_so_far
from fieldtrace.llm.queries import bpe_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts get the score of the bias, repeated rows the same score; a score of exactly the threshold stays.
    """
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line.

    Earlier is by doc_id and line; rows that share a doc_id don't take lines from each other. Null and empty texts, and
    rows without a doc_id, stay as they are; a document goes when all its lines with words do.
    """
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a Jaccard similarity of 0.8 or more.

    The smallest doc_id of a group stays, with all rows that share it. Null and empty texts are near to nothing and stay,
    as do rows without a doc_id.
    """
    return ngram_join.keep_one(docs, tenths=8, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken.

    Null and empty texts have no words and are never taken; a null source is a source. Ties of quotients go by source
    and shard, ties of the seeded order by doc_id. Rows that share a doc_id are taken equally often.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null and empty texts have no tokens, repeated rows come out each."""
    return bpe_digests(docs)


STAGES = [("quality", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("source mix", mix), ("byte-level BPE", encode)]

#: No SQL expresses the first stage. Tests hold the deciding stages against plain versions, and the chain against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage has written on its way goes once its result is written."""
    docs, before = read_table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_scratch(spark, since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
