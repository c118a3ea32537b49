"""Exact ROC AUC and PR AUC as distributed aggregates.

Both curves only need, for every distinct score s (descending), the numbers of
positives and negatives scored at least s. The rows are first reduced to one
row per (group, score) with partial aggregation (a hot score collapses on the
map side), then :func:`prefix_sums` computes the running counts with range
partitioning, so no task or driver sees the whole curve.

* ROC AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P N): the rank-sum
  statistic with mid-ranks for ties.
* PR AUC: trapezoids over (recall, precision) from (0, 1) down to the first
  threshold that reaches full recall, the curve of the reference's metric
  library (Spark's ``areaUnderPR`` starts at (0, p1) instead).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.operators.keyed import join_small, prefix_sums
from tripsense.session import materialize


def _curve(scored: DataFrame, y: str, score: str, group: Sequence[str]) -> DataFrame:
    pts = (scored.groupBy(*group, F.col(score).alias("_s"))
           .agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("_pos"),
                F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("_neg")))
    pts = materialize(pts)  # one row per score; read by the running sums and by the totals
    cum = prefix_sums(pts, list(group) or None, [F.col("_s").desc()], ["_pos", "_neg"])
    totals = pts.groupBy(*group).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    if group:
        return join_small(cum, totals, list(group))
    row = totals.first()
    return cum.withColumns({"_P": F.lit(row["_P"] or 0), "_N": F.lit(row["_N"] or 0)})


def roc_auc(scored: DataFrame, y: str = "y_true", score: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group (column ``roc_auc``); NULL when a class is missing."""
    c = _curve(scored, y, score, group)
    neg_below = F.col("_N") - F.col("_cum__neg")
    term = F.col("_pos") * (neg_below + F.col("_neg") / 2.0)
    out = c.groupBy(*group).agg(F.sum(term).alias("_t"), F.first("_P").alias("_P"), F.first("_N").alias("_N"))
    return out.select(*group, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                     F.col("_t") / (F.col("_P") * F.col("_N"))).alias("roc_auc"))


def pr_auc(scored: DataFrame, y: str = "y_true", score: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve per group (column ``pr_auc``); NULL without positives."""
    c = _curve(scored, y, score, group)
    tp, fp = F.col("_cum__pos"), F.col("_cum__neg")
    tp0, fp0 = tp - F.col("_pos"), fp - F.col("_neg")
    prec = tp / (tp + fp)
    prec0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    rec, rec0 = tp / F.col("_P"), tp0 / F.col("_P")
    term = F.when(tp0 < F.col("_P"), (rec - rec0) * (prec + prec0) / 2.0).otherwise(F.lit(0.0))
    out = c.groupBy(*group).agg(F.sum(term).alias("_a"), F.first("_P").alias("_P"))
    return out.select(*group, F.when(F.col("_P") > 0, F.col("_a")).alias("pr_auc"))


def check_two_classes(scored: DataFrame, y: str = "y_true") -> None:
    """Raise like the reference's metric when only one class is present."""
    classes = scored.select(y).distinct().limit(2).count()
    if classes < 2:
        raise ValueError("ROC AUC is undefined when only one class is present")


def cv_mean_auc(scored: DataFrame, fold: str = "fold", y: str = "y_true", score: str = "y_pred") -> DataFrame:
    """Mean over folds of the per-fold ROC AUC (M7), with the number of folds."""
    per_fold = roc_auc(scored, y, score, [fold])
    return per_fold.agg(F.avg("roc_auc").alias("mean_auc"), F.count(F.lit(1)).alias("folds"))
