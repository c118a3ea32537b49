"""Label resolution and the feature x label join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.operators.keyed import join_small


def last_label(labels: DataFrame, key: str = S.KEY, label: str = S.LABEL,
               order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last non-NULL label in ``order``.

    ``max_by`` is an ordinary partial aggregate, so a key with many label rows
    costs one buffer per task, and the result does not depend on the physical
    row order (unlike ``last`` after a shuffle). Keys whose labels are all NULL
    keep a NULL label. ``order`` must be a total order within a key; without
    one the label value itself breaks ties (largest wins).
    """
    ordering = F.struct(*[F.col(c) for c in order], F.col(label)) if order else F.col(label)
    return labels.groupBy(key).agg(
        F.max_by(F.col(label), F.when(F.col(label).isNotNull(), ordering)).alias(label))


def duplicate_labels(labels: DataFrame, key: str = S.KEY) -> DataFrame:
    """Keys with more than one label row and their row count (A19 + A20 ``having count > 1``)."""
    return labels.groupBy(key).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def join_labels(features: DataFrame, labels: DataFrame, key: str = S.KEY, label: str = S.LABEL) -> DataFrame:
    """Left join one label per key onto the feature rows (J2); a missing label is NULL.

    ``labels`` must already be one row per key (see :func:`last_label`). The
    label table is broadcast only when its counted size allows it.
    """
    return join_small(features, labels.select(key, label), key, "left")


def drop_unlabelled(df: DataFrame, label: str = S.LABEL) -> tuple[DataFrame, int]:
    """Rows with a label, and the number of rows without one."""
    missing = df.filter(F.col(label).isNull()).count()
    return df.filter(F.col(label).isNotNull()), missing
