"""A training corpus from ``documents``: quality, exact copies, near copies, mixture, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and
reread as the next stage's documents. Decisions are narrow tables keyed by ``doc_id``; they are
broadcast after a check of their size, else the join shuffles both sides.

Defined results: rows without a ``doc_id`` are never rejected by quality or near copies; rows
that repeat a ``doc_id`` share the decisions on it; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsense.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from tripsense.llm.common import broadcast_if_small, scratch, table
from tripsense.session import materialize


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    dropped = materialize(ids.select("doc_id").distinct())
    return docs.join(broadcast_if_small(dropped, row_bytes=16), "doc_id", "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return _without(docs, quality.classify(docs, trusted).filter("NOT kept"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every distinct text."""
    return exact_dedup.exact_dedup(docs).filter("_xd_kept").select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked documents."""
    return _without(docs, jaccard_join.jaccard_components(docs).filter("component_id <> doc_id"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it (0 to 2 times)."""
    copies = materialize(mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("_copies")).filter("_copies > 0"))
    copies = copies.withColumnRenamed("doc_id", "_taken_id")
    out = docs.join(broadcast_if_small(copies, row_bytes=24), docs["doc_id"].eqNullSafe(copies["_taken_id"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets of every document, and what decoding the ids gives: its hash and whether it is the text."""
    coded = bpe.bpe_round_trip(docs, bpe.default_vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets", "decoded_sha256", "intact")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: SQL expresses neither the language model nor the tokens; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the intermediate tables lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
