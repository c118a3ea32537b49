"""Queries and SQL of the training-data operators, added to the entry module where this subpackage exists."""

from __future__ import annotations

from tripsense.llm import (
    bpe,
    cross_polytope,
    exact_dedup,
    filter_audit,
    html_content,
    jaccard_join,
    language_id,
    mixing,
    quality,
    spot_signatures,
    substring_dedup,
    warc,
    whitening,
)
from tripsense.llm.common import table


def _documents(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


def _pages(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "pages"))


def _embeddings(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": _documents(language_id.op1),
    "op2_quality": lambda spark, sf_dir: quality.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_mix_sources": _documents(mixing.op3),
    "op4_jaccard_join": _documents(jaccard_join.op4),
    "op5_exact_dedup": _documents(exact_dedup.op5),
    "op6_warc": _pages(warc.op6),
    "op7_html_content": _pages(html_content.op7),
    "op8_byte_bpe": _documents(bpe.op8),
    "op9_spot_signatures": _documents(spot_signatures.op9),
    "op10_substring_dedup": _documents(substring_dedup.op10),
    "op11_filter_audit": lambda spark, sf_dir: filter_audit.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_whitening": _embeddings(whitening.op12),
    "op13_cross_polytope": _embeddings(cross_polytope.op13),
}

SQL = {
    "op3_mix_sources": mixing.SQL,
    "op4_jaccard_join": jaccard_join.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_warc": warc.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
}
