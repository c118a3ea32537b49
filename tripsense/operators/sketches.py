"""Quantile and distinct-count sketches on request (A7, A16, A17, A22); exact operators stay the default.

A sketch is a small binary column that can be stored per day (or any other part of the data) and merged later, so
a quantile over a year needs no second look at its rows. The size of a sketch depends on ``k`` or ``lg_k`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S


def rank_error(k: int) -> float:
    """Error of a quantile's rank as a share of all rows that a KLL sketch keeps with 99 % confidence."""
    return 2.296 / k ** 0.9723


def distinct_error(lg_k: int) -> float:
    """Relative standard error of a distinct count from (merged) HLL sketches."""
    return 1.04 / 2 ** (lg_k / 2)


def quantile_sketches(df: DataFrame, by: Sequence[str], channels: Sequence[str], k: int = 400) -> DataFrame:
    """``by`` and a KLL sketch ``_kll_<c>`` of the non-NULL values of each channel: one partial aggregate."""
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"_kll_{c}") for c in channels])


def merge_quantile_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of all rows with equal ``by`` together (e.g. of all days of a trip)."""
    names = [c for c in sketches.columns if c.startswith("_kll_")]
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c).alias(c) for c in names])


def _at(channel: str, p: float) -> Column:
    sketch = F.col(f"_kll_{channel}")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def sketched_quantiles(sketches: DataFrame, by: Sequence[str], channels: Sequence[str],
                       quantiles: Sequence[float] = S.QUANTILES) -> DataFrame:
    """``<c>_median``, ``<c>_iqr`` and the quantile columns of the exact families, from sketches. Values are values of the
    data (no interpolation); NULL where a channel has none."""
    out = []
    for c in channels:
        out += [_at(c, 0.5).alias(f"{c}_median"), (_at(c, 0.75) - _at(c, 0.25)).alias(f"{c}_iqr")]
        out += [_at(c, p).alias(S.quantile_name(p, c)) for p in quantiles]
    return sketches.select(*by, *out)


def distinct_sketches(df: DataFrame, by: Sequence[str], column: str, lg_k: int = 12) -> DataFrame:
    """``by`` and an HLL sketch ``_hll`` of the distinct values of ``column``."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, lg_k).alias("_hll"))


def merge_distinct_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and the estimated distinct count ``estimate`` over all rows with equal ``by``."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("_hll").alias("_hll"))
    return merged.select(*by, F.coalesce(F.hll_sketch_estimate("_hll"), F.lit(0)).alias("estimate"))
