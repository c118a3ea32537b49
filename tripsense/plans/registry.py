"""Model versions as a table (S6, S7): a version exists once its row is in the table.

A model is written first, into a folder of its own; then one row is appended to the table of versions. The
row's file appears when Spark commits the job, so a reader sees a version either whole or not at all, and
a model half written by a job that died is never picked. Nothing lists or compares folder names.
"""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version long, path string, hyperparameters string"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``version, path, hyperparameters`` of all published models under ``root``."""
    try:
        return spark.read.schema(SCHEMA).json(f"{root.rstrip('/')}/registry")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def publish(model: PipelineModel, root: str, params: dict, version: int | None = None) -> str:
    """Store a model under ``root/<version>/model`` (version: the Unix time, or the next free number after the latest
    one) and publish it. Publishing a version again replaces nothing and is an error."""
    spark = SparkSession.getActiveSession()
    known = versions(spark, root)
    if version is None:
        last = known.agg(F.max("version")).first()[0]
        version = max(int(time.time()), (last or 0) + 1)
    elif not known.filter(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is published already")
    path = f"{root.rstrip('/')}/{version}"
    model.write().overwrite().save(f"{path}/model")  # over what an unpublished attempt left
    row = (version, f"{path}/model", json.dumps(params, sort_keys=True))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/registry")
    return path


def latest(spark: SparkSession, root: str) -> str:
    """The path of the published model with the largest version."""
    path = versions(spark, root).agg(F.max_by("path", "version")).first()[0]
    if path is None:
        raise FileNotFoundError(f"no published model under {root}")
    return path
