"""What the embedding operators share: which rows count, and Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``id, vec`` of the rows whose vector is neither NULL nor empty and holds finite entries only, and the
    dimension. Vectors of another length than the most frequent one (ties: the longer) lie in another space
    and are left out."""
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = (rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
            .filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).filter(F.forall("vec", entry)))
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top[0] if top else 0
    return rows.filter(F.size("vec") == d), d


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """The vectors of a list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), d)


def list_column(x: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).ravel()))
