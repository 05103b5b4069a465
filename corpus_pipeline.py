"""Corpus cleaning in stages. Each stage reads what its predecessor wrote; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm import decontaminate, jaccard, line_chunks, pieces, quality, queries
from ledgerlight.llm.storage import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score quality.KEEP or more; the network learns from labels that aren't held out."""
    net = quality.trained(docs, queries.table(spark, sf_dir, "labels"))
    return quality.scored(docs, net, "_quality").where(F.col("_quality") >= quality.KEEP).drop("_quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of lines that an earlier place has; n_chars follows the text."""
    cut = line_chunks.drop_repeated_chunks(docs, "_removed")
    return cut.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_removed")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id, once; documents without words or id all stay."""
    groups = jaccard.jaccard_components(docs).where("doc_id = component_id and (n_shingles = 0 or key = component_key)")
    kept = groups.groupBy("doc_id", "key", F.when(F.col("n_shingles") == 0, F.col("row")).alias("blank")).agg(F.min("row").alias("_row"))
    named = docs.withColumn("_row", jaccard.row_of("text")).join(kept.select("doc_id", "_row"), ["doc_id", "_row"], "left_semi")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"), allowMissingColumns=True).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of benchmark."""
    return decontaminate.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids, decoded_sha256) of each document left."""
    out = pieces.tokenised(docs, pieces.model_bytes(spark, queries.PIECE_MODEL))
    return out.select("doc_id", "n_tokens", "n_bytes", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: a trained network, components and merges are beyond SQL; tests compare with plain Python versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; each stage's result goes through the shared folder as Parquet."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
