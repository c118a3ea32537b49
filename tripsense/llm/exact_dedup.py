"""Exact deduplication by 128-bit content hash with byte comparison (DataFrame functions only).

Rows are grouped by ``(md5 of the normalised text, normalised text)``: the hash is
the cheap first key, the text in the grouping key compares the bytes, so two
different texts never share a group even if their hashes collide. The partial
aggregate collapses copies inside every input task before the shuffle, hence a
group that holds a third of all rows sends one row per task.

The groups are then attached to the rows by the 16-byte hash alone; only hashes
with several different texts (real collisions) are attached by their text.
The join's row side is narrow and AQE splits it where one hash is hot.

Defined results: NULL text counts as empty; the smallest non-NULL id of a group
stays; rows that repeat both id and text of the kept row are all marked kept;
an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.llm.common import SPACE, text_or_empty
from tripsense.session import materialize


def normalised(text_col: str):
    """The text with every run of ASCII white space replaced by one space (NULL: empty)."""
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def content_groups(docs: DataFrame, id_col: str, text_col: str, hash_fn=F.md5) -> DataFrame:
    """One row per distinct text: ``_h`` (hash), ``_norm``, ``keep_id``, ``group_size``."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"))
    return (rows.groupBy(hash_fn("_norm").alias("_h"), "_norm")
            .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=F.md5) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_xd_keep_id``, ``_xd_group_size``, ``_xd_kept``, ``_xd_sha256``."""
    groups = content_groups(docs, id_col, text_col, hash_fn)
    by_hash = materialize(groups.groupBy("_h").agg(
        F.count(F.lit(1)).alias("_xd_variants"), F.min("keep_id").alias("_xd_keep_id"),
        F.sum("group_size").alias("_xd_group_size")))
    rows = (docs.withColumn("_xd_norm", normalised(text_col))
            .withColumns({"_xd_h": hash_fn("_xd_norm"), "_xd_sha256": F.sha2("_xd_norm", 256)}))
    joined = rows.join(by_hash.withColumnRenamed("_h", "_xd_h"), "_xd_h", "inner")
    out = joined.filter("_xd_variants = 1").drop("_xd_variants")
    if by_hash.filter("_xd_variants > 1").limit(1).count():
        clash = (groups.join(by_hash.filter("_xd_variants > 1").select("_h"), "_h", "left_semi")
                 .select(F.col("_h").alias("_xd_h"), F.col("_norm").alias("_xd_norm"),
                         F.col("keep_id").alias("_xd_keep_id"), F.col("group_size").alias("_xd_group_size")))
        out = out.unionByName(rows.join(clash, ["_xd_h", "_xd_norm"], "inner"))
    return (out.withColumn("_xd_kept", F.col(id_col).eqNullSafe(F.col("_xd_keep_id")))
            .drop("_xd_h", "_xd_norm"))


def op5(docs: DataFrame) -> DataFrame:
    out = exact_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_xd_keep_id").alias("keep_id"),
                      F.col("_xd_group_size").cast("long").alias("group_size"),
                      F.col("_xd_kept").alias("kept"), F.col("_xd_sha256").alias("text_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)"""
