"""Labels, sampling, folds, AUC, profiling and the driver contract."""

import math

import numpy as np
import pandas as pd
import pytest

from tripsense.operators import evaluation as E
from tripsense.operators import profile as P
from tripsense.operators.labels import duplicate_labels, join_labels, last_label
from tripsense.operators.sampling import holdout, kfold, under_sample


def test_last_label_non_null_wins(spark):
    # L1: labels 0 then 1; NULL last; no labels at all for booking 3
    rows = [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, None)]
    labels = spark.createDataFrame(rows, "bookingID long, seq int, label int")
    got = {r["bookingID"]: r["label"] for r in last_label(labels, order=["seq"]).collect()}
    assert got == {1: 1, 2: 1}
    feats = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9)], "bookingID long, f double")
    joined = {r["bookingID"]: r["label"] for r in join_labels(feats, last_label(labels, order=["seq"])).collect()}
    assert joined == {1: 1, 2: 1, 3: None}
    dup = {r["bookingID"]: r["count"] for r in duplicate_labels(labels).collect()}
    assert dup == {1: 2, 2: 2}


def _roc_pandas(y, s):
    ranks = pd.Series(s).rank(method="average").to_numpy()
    p = y.sum()
    n = len(y) - p
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n)


def _pr_pandas(y, s):
    order = np.argsort(-s, kind="mergesort")
    ys, ss = y[order], s[order]
    distinct = np.r_[np.where(np.diff(ss))[0], len(ss) - 1]
    tps = np.cumsum(ys)[distinct]
    fps = (1 + distinct) - tps
    prec, rec = tps / (tps + fps), tps / tps[-1]
    last = np.searchsorted(tps, tps[-1])
    prec, rec = np.r_[prec[last::-1], 1], np.r_[rec[last::-1], 0]
    return -np.trapezoid(prec, rec) if hasattr(np, "trapezoid") else -np.trapz(prec, rec)


def test_auc_with_mixed_tie_on_top(spark):
    # The top score is shared by a positive and a negative
    y = np.array([1, 0, 1, 0, 0, 1, 0, 1, 0, 0])
    s = np.array([0.9, 0.9, 0.8, 0.7, 0.6, 0.6, 0.4, 0.3, 0.2, 0.1])
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": s}))
    roc = E.roc_auc(df).first()["roc_auc"]
    pr = E.pr_auc(df).first()["pr_auc"]
    assert math.isclose(roc, _roc_pandas(y, s), rel_tol=1e-12)
    assert math.isclose(pr, _pr_pandas(y, s), rel_tol=1e-12)


def test_auc_one_class_is_undefined(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y_true int, y_pred double")
    assert E.roc_auc(df).first()["roc_auc"] is None
    with pytest.raises(ValueError):
        E.check_two_classes(df)


def test_grouped_auc_and_cv_mean(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(y, 1.0), 1)
    fold = np.arange(300) % 5
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": s, "fold": fold}))
    per = {r["fold"]: r["roc_auc"] for r in E.roc_auc(df, group=["fold"]).collect()}
    for f in range(5):
        m = fold == f
        assert math.isclose(per[f], _roc_pandas(y[m], s[m]), rel_tol=1e-12)
    mean = E.cv_mean_auc(df).first()
    assert math.isclose(mean["mean_auc"], np.mean([per[f] for f in range(5)]), rel_tol=1e-12)


def test_under_sampling_exact_counts(spark):
    # 10 positives, 35 negatives
    rows = [(i, 1 if i < 10 else 0) for i in range(45)]
    df = spark.createDataFrame(rows, "bookingID long, label int")
    for ratio in (1, 2):
        out = under_sample(df, negative_ratio=ratio).toPandas()
        assert (out["label"] == 1).sum() == 10 and (out["label"] == 0).sum() == 10 * ratio
    again = under_sample(df, negative_ratio=2).toPandas()
    assert sorted(again["bookingID"]) == sorted(under_sample(df, negative_ratio=2).toPandas()["bookingID"])
    with pytest.raises(ValueError):
        under_sample(df, negative_ratio=4)


def test_kfold_and_holdout_sizes(spark):
    df = spark.createDataFrame([(i * 7919,) for i in range(103)], "bookingID long")
    sizes = kfold(df).groupBy("fold").count().toPandas().set_index("fold")["count"].sort_index().tolist()
    assert sizes == [21, 21, 21, 20, 20]
    test = holdout(df).filter("is_test").count()
    assert test == math.ceil(0.2 * 103)
    # same seed, different partitioning: same assignment
    a = {r["bookingID"]: r["fold"] for r in kfold(df.repartition(5)).collect()}
    b = {r["bookingID"]: r["fold"] for r in kfold(df.repartition(2)).collect()}
    assert a == b


def test_histogram_keeps_every_row(spark):
    pdf = pd.DataFrame({"a": np.linspace(0, 1, 101), "b": np.r_[np.zeros(100), 5.0]})
    h = P.histogram(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert h.groupby("column")["count"].sum().to_dict() == {"a": 101, "b": 101}
    assert h["bin"].max() <= 29
    a = h[h["column"] == "a"]
    assert math.isclose((a["density"] * (a["bin_hi"] - a["bin_lo"])).sum(), 1.0, rel_tol=1e-9)


def test_entry_contract(spark):
    import __spark_entry__ as entry
    out = entry.entry(spark)
    assert len(out.columns) == 697
    assert out.count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seeds_give_independent_orders(spark):
    """Folds of two seeds, and folds against the hold-out, are near independent on consecutive ids."""
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = kfold(df, "k", 5, 11).withColumnRenamed("fold", "a")
    both = a.join(kfold(df, "k", 5, 12).withColumnRenamed("fold", "b"), "k").join(holdout(df, "k"), "k")
    cells = {(r["a"], r["b"]): r["count"] for r in both.groupBy("a", "b").count().collect()}
    assert len(cells) == 25 and all(650 < n < 950 for n in cells.values())
    test = {r["a"]: r["count"] for r in both.filter("is_test").groupBy("a").count().collect()}
    assert sum(test.values()) == 4000 and all(650 < n < 950 for n in test.values())


def test_rank_experiments_shares_ranks_on_ties(spark):
    runs = spark.createDataFrame([(1, 0.7, 0.6), (2, 0.8, 0.7), (3, None, 0.9)],
                                 "experiment_id int, average_roc_auc_xgboost double, average_roc_auc_lightgbm double")
    got = {(r["experiment_id"], r["model"][16:]): r["rank"] for r in P.rank_experiments(runs).collect()}
    assert got == {(3, "lightgbm"): 1, (2, "xgboost"): 2, (1, "xgboost"): 3, (2, "lightgbm"): 3, (1, "lightgbm"): 5, (3, "xgboost"): 6}


def test_trip_series_prefix_and_lengths(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 1.0, 4.0), (2, 1.0, 9.0)], "bookingID long, second double, Speed double")
    rows = P.trip_series(df, 1, order=("second",), channels=("Speed",)).collect()
    assert [(r["second"], r["Speed"]) for r in rows] == [(1.0, 4.0), (2.0, 5.0)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "bookingID long, label int")
    assert [r["bookingID"] for r in P.labelled_trips_of_length(df, labels, 2).collect()] == [1]
