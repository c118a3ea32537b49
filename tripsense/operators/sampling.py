"""Exact-count under-sampling, k-fold assignment and hold-out split.

All three need an exact rank of every key in a seeded pseudo-random order.
The order key is ``md5(seed ':' key)``, ties broken by the key: any engine reproduces the
same permutation, and different seeds give independent ones. Ranks come from
:func:`global_rank` (range partitioning + per-partition offsets), so no task
sees the whole table and ``sampleBy``-style approximate counts are avoided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.operators.keyed import global_rank

def seeded_order(key: str, seed: int) -> Column:
    """Deterministic pseudo-random order key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_order_sql(key: str, seed: int) -> str:
    """The same order key as SQL text (also valid in DuckDB)."""
    return f"md5(concat('{seed}:', {key}))"


def under_sample(df: DataFrame, key: str = S.KEY, label: str = S.LABEL, negative_ratio: int = 1,
                 seed: int = S.UNDER_SAMPLING_SEED) -> DataFrame:
    """Keep every positive (label 1) and exactly ``P * negative_ratio`` negatives (label 0).

    Raises when there are fewer negatives than requested (as the original
    sampler does). The label is found by name, not by position.
    """
    positives, negatives = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    wanted = positives * negative_ratio
    if wanted > negatives:
        raise ValueError(f"asked for {wanted} negatives, only {negatives} available")
    neg = df.filter(F.col(label) == 0).withColumn("_ord", seeded_order(key, seed))
    ranked = global_rank(neg, ["_ord", key])
    keep = ranked.filter(F.col("_rank") < wanted).drop("_ord", "_rank", "_size")
    return df.filter(F.col(label) == 1).unionByName(keep)


def kfold(df: DataFrame, key: str = S.KEY, k: int = S.KFOLD_COUNT, seed: int = S.KFOLD_SEED) -> DataFrame:
    """Add ``fold`` in [0, k): shuffled, unstratified, fold sizes differ by at most one.

    Like a shuffled k-fold split, the first ``n mod k`` folds hold one row more.
    """
    ranked = global_rank(df.withColumn("_ord", seeded_order(key, seed)), ["_ord", key])
    n, r = F.col("_size"), F.col("_rank")
    q, big = F.floor(n / k), n % k
    fold = F.when(r < big * (q + 1), F.floor(r / (q + 1))).otherwise(big + F.floor((r - big * (q + 1)) / q))
    return ranked.withColumn("fold", fold.cast("int")).drop("_ord", "_rank", "_size")


def holdout(df: DataFrame, key: str = S.KEY, test_fraction: float = S.HOLDOUT_FRACTION,
            seed: int = S.HOLDOUT_SEED) -> DataFrame:
    """Add ``is_test``: ceil(test_fraction * n) rows of a seeded permutation are test rows."""
    ranked = global_rank(df.withColumn("_ord", seeded_order(key, seed)), ["_ord", key])
    return (ranked.withColumn("is_test", F.col("_rank") < F.ceil(F.col("_size") * F.lit(test_fraction)))
            .drop("_ord", "_rank", "_size"))
