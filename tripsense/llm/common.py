"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsense.session import ensure_checkpoint_dir

#: ASCII white space that separates words (space, tab to carriage return), as a Java and RE2 pattern
SPACE = r"[\x20\x09-\x0D]+"
#: a word: a maximal run of anything else
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` (whose rows take ``row_bytes``) fits ``limit_bytes``; counts one row past the limit at most."""
    most = limit_bytes // row_bytes
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its checked size allows; else Spark shuffles both sides of the join."""
    return F.broadcast(df) if small_enough(df, row_bytes) else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
