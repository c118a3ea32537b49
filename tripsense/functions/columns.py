"""Scalar column helpers: norms, NaN policy, log1p, prefix selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes NULL so that Spark's aggregates skip it like pandas does."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), col)


def norm3(x: str, y: str, z: str) -> Column:
    """Euclidean norm sqrt(x^2 + y^2 + z^2) of three columns."""
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def with_norms(df: DataFrame) -> DataFrame:
    """Append ``total_acceleration`` and ``total_gyro`` to a telemetry frame.

    Unlike the original it does not mutate its input: a new frame is returned.
    """
    return df.withColumns({
        S.TOTAL_ACC: norm3("acceleration_x", "acceleration_y", "acceleration_z"),
        S.TOTAL_GYRO: norm3("gyro_x", "gyro_y", "gyro_z"),
    })


def log1p_shift(c: str, shift: float = S.LOG1P_SHIFT) -> Column:
    """log1p(x + 10) (P9). Spark yields NULL where x + 10 <= -1."""
    return F.log1p(F.col(c) + F.lit(shift))


def select_prefix(df: DataFrame, prefixes: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Select ``keep`` plus every column whose name starts with one of ``prefixes``."""
    prefixes = tuple(prefixes)
    keep = list(keep)
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefixes) and c not in keep])
