"""Queries of the corpus operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import bpe, collocations, embedding_dedup, licenses, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, token_alignment, toxicity
from fieldtrace.llm.common import materialise, read_table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    gone = line_dedup.removed_lines(docs).select("doc_id", "n_removed", F.concat_ws(",", F.transform("nos", lambda i: i.cast("string"))).alias("removed"))
    every = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.size(F.split("text", "\n")), F.lit(0))).cast("long").alias("n_lines"))
    return every.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


#: The vocabulary of the BPE query.
RANKS = "byte_bpe_multi_50k.tiktoken"


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode and digest every text of ``docs``."""
    ranks = public_tokenizers.path(RANKS)
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.removed_bytes(read_table(spark, sf_dir, "documents")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The byte-level vocabulary of packing and alignment, and the one it is aligned with.
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN, end_id=2)
    # Places depend on lengths alone, so what travels is the digest of the ids, not the ids.
    placed = packing.place(materialise(packing.with_crc(pieces), "packing-digests"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_line_dedup, op3_byte_bpe, op4_suffix_dedup, op5_license_scan, op6_quality_classifier, op7_embedding_dedup, op8_quality_rules, op9_toxicity, op10_source_mix, op11_best_fit_packing, op12_token_alignment, op13_collocations)}
