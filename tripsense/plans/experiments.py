"""The experiment table: feature and sampling variants compared by cross-validated AUC (M7 with O7, P9, M11, M12, S3, O10).

All runs share one stored matrix of features, labels and folds. What an experiment does to the data happens inside the
training folds only: under-sampling leaves the scored fold as it is, and the features of a top-k run
are the most important ones of the base run's model *of the same fold*, so no scored row chooses its own inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.functions.columns import log1p_shift
from tripsense.operators.evaluation import cv_mean_auc
from tripsense.operators.profile import rank_experiments
from tripsense.operators.sampling import holdout, kfold, under_sample
from tripsense.plans.boosting import fit_with_patience
from tripsense.plans.modeling import BOOSTED, FOREST_TREES, PATIENCE, build_pipeline, feature_importance, nullable_features, typed
from tripsense.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Experiment:
    """``log1p``: transform the listed columns; ``negative_ratio``: under-sample to so many negatives a positive;
    ``top``: only so many features, by the importance of experiment ``base``."""
    experiment_id: int
    changes: str
    log1p: bool = False
    negative_ratio: int | None = None
    top: int | None = None
    base: int = 1


#: the eight runs of the original
EXPERIMENTS = (
    Experiment(1, "more features"),
    Experiment(2, "with log1p", log1p=True),
    Experiment(3, "random under-sampling 1:1", negative_ratio=1),
    Experiment(4, "random under-sampling 1:2", negative_ratio=2),
    Experiment(5, "top 50 features", top=50),
    Experiment(6, "top 100 features", top=100),
    Experiment(7, "top 150 features", top=150),
    Experiment(8, "top 200 features", top=200),
)
#: model family -> AUC column of the experiment table
COLUMNS = {"gbt": "average_roc_auc_xgboost", "gbt2": "average_roc_auc_lightgbm", "forest": "average_roc_auc_lightgbm"}


def _fit(train: DataFrame, columns: Sequence[str], family: str, params: dict, rounds: int | None, patience: int, label: str, key: str):
    nullable = nullable_features(train, columns)

    def pipeline(n):
        return build_pipeline(columns, family, label, {**typed(params), "maxIter" if family in BOOSTED else "numTrees": n}, nullable=nullable)

    if family not in BOOSTED:
        return pipeline(rounds or FOREST_TREES).fit(train)
    split = holdout(train, key).persist()  # boosting stops on rows of the training folds, never on the scored fold
    try:
        return fit_with_patience(split.filter(~F.col("is_test")), split.filter(F.col("is_test")), pipeline, rounds or BOOSTED[family], patience, label)[0]
    finally:
        split.unpersist()


def run_experiments(features: DataFrame, feature_cols: Sequence[str], experiments: Sequence[Experiment] = EXPERIMENTS,
                    families: Sequence[str] = ("gbt", "gbt2"), label: str = S.LABEL, key: str = S.KEY, folds: int = S.KFOLD_COUNT,
                    log1p_cols: Sequence[str] = S.LOG1P_COLUMNS, params: dict[str, dict] | None = None, rounds: int | None = None,
                    patience: int = PATIENCE) -> DataFrame:
    """``experiment_id, changes`` and the mean fold AUC of each family, from labelled rows (no NULL label).

    ``families``: one for each AUC column (the second one of boosted trees, ``gbt2``, or ``forest``).
    ``params``: fixed parameters per family (e.g. the best of ``cross_validate``). Rows are scored by models that
    have not seen their fold. A ``top`` run needs its base run before it in ``experiments``.
    """
    spark = features.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/experiments-{uuid.uuid4().hex}"
    kfold(features.select(key, label, *feature_cols).withColumn(label, F.col(label).cast("double")), key, folds).write.parquet(path)
    data, order, out = spark.read.parquet(path), {}, []
    for e in experiments:
        rows = data
        if e.log1p:
            rows = rows.withColumns({c: log1p_shift(c) for c in log1p_cols if c in set(feature_cols)})
        aucs = {}
        for family in families:
            scored = []
            for fold in range(folds):
                train = rows.filter(F.col("fold") != fold).drop("fold")
                if e.negative_ratio is not None:
                    train = under_sample(train, key, label, e.negative_ratio)
                columns = list(feature_cols)
                if e.top is not None:
                    if (e.base, family, fold) not in order:
                        raise ValueError(f"experiment {e.experiment_id} needs experiment {e.base} before it")
                    columns = order[e.base, family, fold][:e.top]
                model = _fit(train, columns, family, (params or {}).get(family, {}), rounds, patience, label, key)
                if any(x.top is not None and x.base == e.experiment_id for x in experiments):
                    order[e.experiment_id, family, fold] = [c for c, _ in feature_importance(model, columns, len(columns))]
                held = model.transform(rows.filter(F.col("fold") == fold))
                scored.append(held.select("fold", F.col(label).cast("int").alias("y_true"), vector_to_array("probability")[1].alias("y_pred")))
            aucs[family] = cv_mean_auc(reduce(DataFrame.unionByName, scored)).first()["mean_auc"]
        out.append((e.experiment_id, e.changes, *[next((aucs[f] for f in families if COLUMNS[f] == c), None) for c in dict.fromkeys(COLUMNS.values())]))
    return spark.createDataFrame(out, S.EXPERIMENT_SCHEMA)


def ranked_experiments(table: DataFrame) -> DataFrame:
    """All runs of an experiment table by falling AUC."""
    return rank_experiments(table, value_cols=tuple(dict.fromkeys(COLUMNS.values())))
