"""Model training, scoring, validation and storage on Spark ML.

Boosted trees are ``GBTClassifier`` (logistic loss). Short trips leave features NULL, and Spark's trees have no
branch for missing values, so a feature with NULLs is offered twice: with NULL below all values and with NULL
above. A split on either then sends NULL to the side that fits better, which is what a learned default branch does. The
number of rounds follows the exact AUC of every stage with patience (:mod:`tripsense.plans.boosting`). The reference's DART
boosters and Bayesian (TPE) search are replaced by Spark ML's gradient
boosting and a seeded random search over a parameter space evaluated with
``CrossValidator`` on a fold column. Scores therefore differ from the
reference's; the flow (search -> k-fold AUC -> final fit on a hold-out split ->
save -> load -> score) is the same.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.operators.keyed import global_rank
from tripsense.operators.sampling import holdout, kfold, seeded_order
from tripsense.operators.trip_aggregates import q
from tripsense.plans import registry
from tripsense.session import materialize

#: rounds of the model families and evaluations of the search
GBT_ROUNDS = 1000
SECOND_GBT_ROUNDS = 500
FOREST_TREES = 500
TRIALS = 100
#: values a partition of the training data has at least
PARTITION_CELLS = 1 << 20
#: rounds without a better AUC after which boosting stops
PATIENCE = 50
#: parameter spaces: a list is a choice, ("uniform", low, high), ("loguniform", low, high) and
#: ("quniform", low, high, step) are draws
GBT_SPACE = {"maxDepth": ("quniform", 2, 6, 1), "stepSize": ("loguniform", 0.01, 0.3), "subsamplingRate": ("uniform", 0.5, 1.0),
             "minInstancesPerNode": ("quniform", 1, 6, 1)}
#: the second boosted family: deeper trees on finer bins, held back by the rows a leaf needs
SECOND_GBT_SPACE = {"maxDepth": ("quniform", 4, 8, 1), "stepSize": ("loguniform", 0.01, 0.2), "subsamplingRate": ("uniform", 0.5, 1.0),
                    "minInstancesPerNode": ("quniform", 5, 40, 5), "maxBins": ("quniform", 200, 300, 10)}
FOREST_SPACE = {"maxDepth": ("quniform", 4, 10, 1), "subsamplingRate": ("uniform", 0.5, 1.0),
                "minInstancesPerNode": ("quniform", 5, 40, 5), "maxBins": ("quniform", 200, 300, 10)}

#: parameter space of each family, and the rounds of the boosted ones
SPACES = {"gbt": GBT_SPACE, "gbt2": SECOND_GBT_SPACE, "forest": FOREST_SPACE}
BOOSTED = {"gbt": GBT_ROUNDS, "gbt2": SECOND_GBT_ROUNDS}


#: where NULL stands beside the values of a feature: below all and above all
_FILLS = {"__low": -1e300, "__high": 1e300}


def nullable_features(df: DataFrame, feature_cols: Sequence[str]) -> list[str]:
    """The features that are NULL (or NaN) in some row: one aggregate."""
    known = [F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(str(k)) for k, c in enumerate(feature_cols)]
    rows, *counts = df.agg(F.count(F.lit(1)), *known).first()
    return [c for c, n in zip(feature_cols, counts) if n < rows]


def _features_stage(feature_cols: Sequence[str], nullable: Sequence[str]) -> list:
    """Fill stage and assembler: features with NULLs enter once with NULL as the lowest, once as the highest value."""
    value = lambda c: f"nanvl(CAST({q(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    fills = [f"coalesce({value(c)}, {fill!r}D) AS {q(c + suffix)}" for c in feature_cols
             for suffix, fill in _FILLS.items() if c in set(nullable) or suffix == "__low"]
    names = [c + suffix for c in feature_cols for suffix in _FILLS if c in set(nullable) or suffix == "__low"]
    return [SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__"),
            VectorAssembler(inputCols=names, outputCol="features")]


def build_pipeline(feature_cols: Sequence[str], family: str = "gbt", label: str = S.LABEL,
                   params: dict | None = None, seed: int = 11, nullable: Sequence[str] | None = None) -> Pipeline:
    """Filling + assembler + classifier; ``family`` is ``gbt`` (M3), ``gbt2`` or ``forest`` (M4). ``nullable``: the features that may
    send NULL either way (all, unless named); NULL in another one counts as lowest."""
    params = dict(params or {})
    if family in BOOSTED:
        clf = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **params)
    elif family == "forest":
        clf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed, **params)
    else:
        raise ValueError(f"family must be one of {sorted(SPACES)}")
    return Pipeline(stages=[*_features_stage(feature_cols, feature_cols if nullable is None else nullable), clf])


def score(model: PipelineModel, features: DataFrame, feature_cols: Sequence[str], key: str = S.KEY) -> DataFrame:
    """Probability of class 1 per key (M6): ``key, probability``."""
    scored = model.transform(features.select(key, *feature_cols))
    return scored.select(key, vector_to_array("probability")[1].alias("probability"))


def draw(domain, rng: random.Random):
    """One value of a domain (see :data:`GBT_SPACE`)."""
    if isinstance(domain, list):
        return rng.choice(domain)
    kind, low, high, *step = domain
    if kind == "loguniform":
        return math.exp(rng.uniform(math.log(low), math.log(high)))
    x = rng.uniform(low, high)
    return low + round((x - low) / step[0]) * step[0] if kind == "quniform" else x


def sample_params(space: dict, n: int, seed: int = 0) -> list[dict]:
    """Seeded random draws from a parameter space (M8, replacing TPE)."""
    rng = random.Random(seed)
    return [{name: draw(dom, rng) for name, dom in space.items()} for _ in range(n)]


def with_class_weight(df: DataFrame, label: str = S.LABEL, scale_pos_weight: float = 1.0) -> DataFrame:
    """``_weight``: ``scale_pos_weight`` for positives, 1 for negatives."""
    return df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0)))


def _rounds(family: str, rounds: int | None) -> dict:
    return {"maxIter": rounds or BOOSTED[family]} if family in BOOSTED else {"numTrees": rounds or FOREST_TREES}


def cross_validate(train: DataFrame, feature_cols: Sequence[str], family: str = "gbt", label: str = S.LABEL,
                   trials: int = TRIALS, folds: int = S.KFOLD_COUNT, key: str = S.KEY, seed: int = 0,
                   parallelism: int = 2, rounds: int | None = None, validation_tol: float = 0.01,
                   scale_pos_weight: float = 1.0) -> list[tuple[dict, float]]:
    """Random search of ``trials`` parameter sets by k-fold ROC AUC on a seeded fold column (M7, M8).

    Boosted trees stop early (M5, by Spark's validation loss) on a seeded tenth of each training fold, never on the scored
    fold (N8). Scores are the exact AUC (no bins). Returns (params, mean AUC) of each trial.
    """
    data = with_class_weight(kfold(train, key, folds), label, scale_pos_weight)
    ranked = global_rank(data.withColumn("_ord", seeded_order(key, seed + 1)), ["_ord", key], "fold")
    data = (ranked.withColumn("_stop", F.col("_rank") < F.ceil(F.col("_size") * 0.1)).drop("_ord", "_rank", "_size")
            .withColumn(label, F.col(label).cast("double")))
    fixed = {**_rounds(family, rounds), "weightCol": "_weight"}
    if family in BOOSTED:
        fixed.update(validationIndicatorCol="_stop", validationTol=validation_tol)
    pipe = build_pipeline(feature_cols, family, label, fixed, nullable=nullable_features(train, feature_cols))
    clf = pipe.getStages()[-1]
    draws = sample_params(SPACES[family], trials, seed)
    grid = []
    for d in draws:
        pm = ParamGridBuilder()
        for name, v in d.items():
            param = clf.getParam(name)
            pm = pm.addGrid(param, [int(v) if isinstance(clf.getOrDefault(param), int) else v])
        grid += pm.build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid,
                        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0),
                        foldCol="fold", numFolds=folds, parallelism=parallelism, seed=seed)
    return list(zip(draws, cv.fit(data).avgMetrics))


def typed(params: dict) -> dict:
    """Drawn parameters with whole numbers where Spark wants them."""
    return {k: v if k in ("stepSize", "subsamplingRate") else int(v) for k, v in params.items()}


def gathered(table: DataFrame, columns: int) -> DataFrame:
    """``table`` (stored) in partitions of ``PARTITION_CELLS`` values at least: every level of every tree is a job over all
    partitions, so partitions of a few rows cost more than the rows."""
    return table.coalesce(max(1, -(-table.count() * max(columns, 1) // PARTITION_CELLS)))


def fit_final(train: DataFrame, feature_cols: Sequence[str], params: dict, family: str = "gbt",
              label: str = S.LABEL, key: str = S.KEY, rounds: int | None = None, scale_pos_weight: float = 1.0,
              patience: int = PATIENCE) -> tuple[PipelineModel, DataFrame]:
    """Final fit with a seeded 80/20 hold-out split (M2). Boosted trees stop ``patience`` rounds after the
    best exact AUC on the 20 % part (M5) and keep the rounds up to it. Returns the model and the scored hold-out
    rows (``key, y_true, y_pred``)."""
    from tripsense.plans.boosting import fit_with_patience
    split = materialize(with_class_weight(holdout(train, key), label, scale_pos_weight).withColumn(label, F.col(label).cast("double")))
    split = gathered(split, len(feature_cols))
    fit, held = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    params = {"weightCol": "_weight", **typed(params)}
    nullable = nullable_features(split, feature_cols)
    if family in BOOSTED:
        model, _ = fit_with_patience(fit, held, lambda n: build_pipeline(feature_cols, family, label, {**params, "maxIter": n}, nullable=nullable),
                                     rounds or BOOSTED[family], patience, label)
    else:
        model = build_pipeline(feature_cols, family, label, {**_rounds(family, rounds), **params}, nullable=nullable).fit(fit)
    val = model.transform(held)
    return model, val.select(key, F.col(label).cast("int").alias("y_true"),
                             vector_to_array("probability")[1].alias("y_pred"))


def feature_importance(model: PipelineModel, feature_cols: Sequence[str], k: int = 100) -> list[tuple[str, float]]:
    """Top-k (feature, importance) of a fitted tree model (M12); both forms of a feature count for it."""
    merged = dict.fromkeys(feature_cols, 0.0)
    for name, weight in zip(model.stages[-2].getInputCols(), model.stages[-1].featureImportances.toArray()):
        merged[name.rsplit("__", 1)[0]] += float(weight)
    return sorted(merged.items(), key=lambda kv: (-kv[1], kv[0]))[:k]


def save_model(model: PipelineModel, root: str, params: dict, version: int | None = None) -> str:
    """Store and publish the model and its parameters (S6); see :mod:`tripsense.plans.registry`."""
    return registry.publish(model, root, params, version)


def latest_model_path(root: str) -> str:
    """The path of the latest published model under ``root``."""
    return registry.latest(SparkSession.getActiveSession(), root)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
