"""Boosting with patience, NULL on either side of a split, and the experiment runner, on planted data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.plans import boosting as B
from tripsense.plans import modeling as M
from tripsense.plans.experiments import EXPERIMENTS, Experiment, ranked_experiments, run_experiments


def auc(y, s):
    r = pd.Series(s).rank()
    p = (y == 1).sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def table(spark, x, y, names=None):
    names = names or [f"f{k}" for k in range(x.shape[1])]
    rows = [(k, float(b), *[None if np.isnan(v) else float(v) for v in a]) for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"{S.KEY} long, {S.LABEL} double, " + ", ".join(f"{n} double" for n in names)), names


def planted(n=240, noise=0.35, seed=3, wide=4):
    """One feature decides, with labels flipped at random; the others are noise to overfit on."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, wide))
    y = (x[:, 0] > 0).astype(float)
    return x, np.where(rng.random(n) < noise, 1 - y, y)


def test_stage_scores_are_those_of_shorter_models(spark):
    x, y = planted()
    df, names = table(spark, x, y)
    pipe = lambda n: M.build_pipeline(names, "gbt", params={"maxIter": n, "maxDepth": 3})
    model = pipe(6).fit(df)
    aucs = B.stage_aucs(model, df, S.LABEL)
    assert sorted(aucs) == [1, 2, 3, 4, 5, 6]
    for n in (1, 4, 6):
        scored = pipe(n).fit(df).transform(df).select(S.LABEL, vector_to_array("probability")[1].alias("p")).toPandas()
        assert abs(auc(scored[S.LABEL].to_numpy(), scored["p"].to_numpy()) - aucs[n]) < 1e-9
    assert B.stage_aucs(model, df, S.LABEL, [2, 5]) == {2: aucs[2], 5: aucs[5]}


def test_patience_stops_at_the_best_stage(spark):
    """Deep trees on noisy labels: the AUC of unseen rows is best early, and boosting ends long before its rounds."""
    x, y = planted()
    df, names = table(spark, x, y)
    train, valid = df.filter(f"{S.KEY} % 3 <> 0"), df.filter(f"{S.KEY} % 3 = 0")
    fits = []

    def pipe(n):
        fits.append(n)
        return M.build_pipeline(names, "gbt", params={"maxIter": n, "maxDepth": 4, "stepSize": 0.5})

    model, aucs = B.fit_with_patience(train, valid, pipe, 500, 4, S.LABEL)
    best = min(aucs, key=lambda s: (-aucs[s], s))
    assert model.stages[-1].getNumTrees == best and best + 4 <= max(aucs) < 500
    assert all(aucs[s] <= aucs[best] for s in aucs) and aucs[max(aucs)] < aucs[best]
    assert fits[0] == 8 and all(b == 2 * a for a, b in zip(fits[:-2], fits[1:-1]))
    one_class, known = B.fit_with_patience(train, valid.filter(f"{S.LABEL} = 1"), pipe, 500, 2, S.LABEL)
    assert one_class.stages[-1].getNumTrees == 4 and set(known.values()) == {None}


def test_final_fit_uses_patience(spark):
    x, y = planted(150)
    df, names = table(spark, x, y)
    model, held = M.fit_final(df, names, {"maxDepth": 3.0, "stepSize": 0.4, "maxBins": 200.0}, "gbt2", rounds=40, patience=3)
    assert 1 <= model.stages[-1].getNumTrees < 40 and held.count() == 30
    assert held.columns == [S.KEY, "y_true", "y_pred"]


@pytest.mark.parametrize("missing_is", ["high", "low"])
def test_null_goes_to_the_side_that_fits(spark, missing_is):
    """Class 1 is missing or high (or missing or low): one split separates, NULL beside the right values."""
    rng = np.random.default_rng(5)
    v = rng.uniform(0, 10, 200)
    y = (v > 5 if missing_is == "high" else v < 5).astype(float)
    gone = (rng.random(200) < 0.5) & (y == 1)
    x = np.column_stack([np.where(gone, np.nan, v), rng.normal(size=200)])
    df, names = table(spark, x, y)
    assert M.nullable_features(df, names) == ["f0"]
    model = M.build_pipeline(names, "gbt", params={"maxIter": 1, "maxDepth": 1, "maxBins": 256}, nullable=["f0"]).fit(df)
    scored = M.score(model, df, names).toPandas().set_index(S.KEY)["probability"]
    assert auc(y, scored.loc[range(200)].to_numpy()) == 1.0
    assert M.feature_importance(model, names, 2) == [("f0", 1.0), ("f1", 0.0)]
    nan = df.withColumn("f0", F.coalesce("f0", F.lit(float("nan"))))
    assert np.array_equal(M.score(model, nan, names).toPandas().set_index(S.KEY)["probability"].loc[range(200)], scored.loc[range(200)])


def test_search_tries_several_parameter_sets(spark):
    x, y = planted(300, noise=0.1)
    df, names = table(spark, x, y)
    found = M.cross_validate(df, names, "forest", trials=2, folds=2, rounds=3)
    assert len(found) == 2 and found[0][0] != found[1][0] and all(0.5 < a <= 1 for _, a in found)


def test_experiment_table(spark):
    """Eight kinds of run on planted data: a few informative features among noise, unbalanced classes."""
    rng = np.random.default_rng(1)
    n = 160
    x = rng.normal(size=(n, 6))
    x[:, 1] = np.exp(x[:, 1])
    y = (x[:, 0] + 0.2 * rng.normal(size=n) > 0.7).astype(float)
    df, names = table(spark, x, y)
    plan = [Experiment(1, "all"), Experiment(2, "log1p", log1p=True), Experiment(3, "1:1", negative_ratio=1), Experiment(4, "top", top=1)]
    out = run_experiments(df, names, plan, families=("forest",), folds=2, log1p_cols=["f1"], rounds=4, params={"forest": {"maxDepth": 3.0}})
    rows = {r["experiment_id"]: r for r in out.collect()}
    assert out.schema == S.EXPERIMENT_SCHEMA and list(rows) == [1, 2, 3, 4]
    assert all(r["average_roc_auc_lightgbm"] > 0.8 and r["average_roc_auc_xgboost"] is None for r in rows.values())
    assert rows[4]["average_roc_auc_lightgbm"] > 0.9  # the one feature that decides was found in every fold
    ranked = [r for r in ranked_experiments(out).collect() if r["model"] == "average_roc_auc_lightgbm"]
    best = max(rows.values(), key=lambda r: r["average_roc_auc_lightgbm"])["experiment_id"]
    assert min(ranked, key=lambda r: r["rank"])["experiment_id"] == best
    with pytest.raises(ValueError):
        run_experiments(df, names, [Experiment(5, "top", top=2)], families=("forest",), folds=2, rounds=1)


def test_under_sampling_stays_inside_the_training_folds(spark, monkeypatch):
    from tripsense.plans import experiments as E
    seen = []
    original = E._fit

    def watch(train, *a):
        seen.append((train.filter("label = 1").count(), train.filter("label = 0").count()))
        return original(train, *a)

    monkeypatch.setattr(E, "_fit", watch)
    x, y = planted(90, noise=0.0)
    y = np.where(np.arange(90) % 3 == 0, 1.0, 0.0)
    df, names = table(spark, x, y)
    out = run_experiments(df, names, [Experiment(4, "1:2", negative_ratio=1)], families=("gbt",), folds=3, rounds=2, patience=1)
    assert len(seen) == 3 and all(p == q for p, q in seen) and sum(p for p, _ in seen) == 60  # each positive trains in two folds
    assert out.first()["average_roc_auc_xgboost"] is not None


def test_the_eight_runs_of_the_original():
    assert [e.experiment_id for e in EXPERIMENTS] == list(range(1, 9))
    assert [(e.log1p, e.negative_ratio, e.top) for e in EXPERIMENTS] == [
        (False, None, None), (True, None, None), (False, 1, None), (False, 2, None), (False, None, 50), (False, None, 100),
        (False, None, 150), (False, None, 200)]
