"""Boosting with patience on the exact AUC (M5).

Spark's own early stopping watches the validation loss and stops at the first small gain. Here the validation
rows are scored at every stage of a fitted model (the margins of all prefixes of its trees), the exact AUC of each
stage is taken, and boosting ends once ``patience`` rounds have brought no better one. Spark can't go on with a
fitted model, so the number of rounds doubles from ``2 * patience`` until that holds (all fits together cost less than
three times the last one); a seeded fit of fewer rounds is the prefix of a longer one.

The trees come from the model as Spark stores it. Their table grows with rounds and depth, not with the data, so it
goes to the tasks with the scoring function; rows stay distributed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsense.operators.evaluation import roc_auc
from tripsense.session import ensure_checkpoint_dir


def stored_trees(model, spark: SparkSession) -> list[dict[str, np.ndarray]]:
    """Per tree of a fitted ensemble its nodes as arrays: ``feature`` (-1: leaf), ``threshold``, ``left``, ``right``,
    ``value`` (prediction times the weight of the tree)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    rows = nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).toPandas()
    out = []
    for (_, tree), weight in zip(rows.sort_values(["treeID", "id"]).groupby("treeID"), model.treeWeights):
        out.append({"feature": np.where(tree["leftChild"] < 0, -1, tree["feature"]), "threshold": tree["threshold"].to_numpy(float),
                    "left": tree["leftChild"].to_numpy(), "right": tree["rightChild"].to_numpy(), "value": tree["prediction"].to_numpy() * weight})
    return out


def tree_values(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """What one tree adds to the margin of each row."""
    at = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(tree["feature"][at] >= 0)
    while len(inner):
        node = at[inner]
        left = x[inner, tree["feature"][node]] <= tree["threshold"][node]
        at[inner] = np.where(left, tree["left"][node], tree["right"][node])
        inner = inner[tree["feature"][at[inner]] >= 0]
    return tree["value"][at]


def staged_margins(rows: DataFrame, trees: Sequence[dict], label: str, stages: Sequence[int]) -> DataFrame:
    """``stage, y_true, y_pred``: margin of every row of ``rows`` (with ``features``) after each of ``stages`` trees."""
    wanted = np.asarray(sorted(stages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            margin = np.cumsum([tree_values(t, x) for t in trees[:wanted[-1]]], axis=0)[wanted - 1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(wanted)), pa.array(margin.T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), lists], ["y_true", "margins"])

    margins = (rows.select(F.col(label).cast("int").alias("y"), vector_to_array("features").alias("x"))
               .mapInArrow(run, "y_true int, margins array<double>"))
    return margins.select("y_true", F.posexplode("margins").alias("_at", "y_pred")).select(
        F.element_at(F.array(*[F.lit(int(s)) for s in wanted]), F.col("_at") + 1).alias("stage"), "y_true", "y_pred")


def stage_aucs(model: PipelineModel, rows: DataFrame, label: str, stages: Sequence[int] | None = None) -> dict[int, float]:
    """The exact AUC on ``rows`` after each stage (all, unless named) of a fitted pipeline of boosted trees."""
    boosted = model.stages[-1]
    stages = stages or range(1, boosted.getNumTrees + 1)
    prepared = PipelineModel(model.stages[:-1]).transform(rows)
    scored = staged_margins(prepared, stored_trees(boosted, rows.sparkSession), label, stages)
    return {r["stage"]: r["roc_auc"] for r in roc_auc(scored, group=["stage"]).collect()}


def fit_with_patience(train: DataFrame, valid: DataFrame, pipeline: Callable[[int], Pipeline], rounds: int, patience: int,
                      label: str) -> tuple[PipelineModel, dict[int, float]]:
    """The model of the best stage on ``valid`` and the AUC of all stages tried. ``pipeline(n)``: one of ``n`` rounds.
    Of equal stages the first counts; without both classes in ``valid`` no stage is better than another, and the rounds
    of the first fit are kept."""
    n = min(rounds, 2 * patience)
    while True:
        model = pipeline(n).fit(train)
        aucs = stage_aucs(model, valid, label)
        if not aucs or None in aucs.values():
            return model, aucs
        best = min(aucs, key=lambda s: (-aucs[s], s))
        if n - best >= patience or n == rounds or model.stages[-1].getNumTrees < n:
            return (model if best == n else pipeline(best).fit(train)), aucs
        n = min(rounds, 2 * n)
