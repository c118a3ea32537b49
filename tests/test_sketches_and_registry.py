"""Sketches against exact values, model versions, broadcast checks and the two-scan plan."""

import glob
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.operators import sketches as K
from tripsense.operators.keyed import fits_broadcast, join_small
from tripsense.plans import registry as R


def test_merged_quantile_sketches_keep_the_rank_error(spark):
    rng = np.random.default_rng(0)
    n = 40_000
    pdf = pd.DataFrame({"k": rng.integers(0, 2, n), "day": rng.integers(0, 5, n), "x": rng.gamma(2, 3, n)})
    df = spark.createDataFrame(pdf).repartition(7)
    days = K.quantile_sketches(df, ["k", "day"], ["x"], 200)
    assert days.count() == 10
    got = K.sketched_quantiles(K.merge_quantile_sketches(days, ["k"]), ["k"], ["x"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for p, name in [(0.5, "x_median"), *((p, S.quantile_name(p, "x")) for p in S.QUANTILES)]:
            assert abs((g.x <= got.loc[k, name]).mean() - p) <= 2 * K.rank_error(200)
    few = spark.createDataFrame([(1, 2.0), (1, None), (2, None)], "k long, x double")
    rows = {r["k"]: r for r in K.sketched_quantiles(K.quantile_sketches(few, ["k"], ["x"]), ["k"], ["x"]).collect()}
    assert rows[1]["x_median"] == 2.0 and rows[1]["x_iqr"] == 0.0 and rows[2]["x_median"] is None


def test_merged_distinct_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("u"), (F.col("id") % 7).alias("day"))
    one = K.merge_distinct_sketches(K.distinct_sketches(df, ["day"], "u")).first()["estimate"]
    assert abs(one - 20_000) <= 4 * K.distinct_error(12) * 20_000
    per = K.merge_distinct_sketches(K.distinct_sketches(df, ["day"], "u"), ["day"])
    assert per.count() == 7
    assert K.merge_distinct_sketches(K.distinct_sketches(df.limit(0), ["day"], "u")).first()["estimate"] == 0


def test_half_written_versions_are_never_picked(spark):
    root = tempfile.mkdtemp(prefix="tripsense-models-")
    model = lambda n: PipelineModel([SQLTransformer(statement=f"SELECT *, {n} AS n FROM __THIS__")])
    with pytest.raises(FileNotFoundError):
        R.latest(spark, root)
    assert R.publish(model(1), root, {"a": 1}, version=9) == f"{root}/9"
    R.publish(model(2), root, {"a": 2}, version=10)  # larger as a number, smaller as text
    model(3).write().save(f"{root}/11/model")  # a job that died before it published
    os.makedirs(f"{root}/12/model/metadata")
    assert R.latest(spark, root) == f"{root}/10/model"
    assert PipelineModel.load(R.latest(spark, root)).transform(spark.range(1)).first()["n"] == 2
    R.publish(model(4), root, {}, version=11)  # the next attempt replaces what was left
    assert PipelineModel.load(R.latest(spark, root)).transform(spark.range(1)).first()["n"] == 4
    with pytest.raises(ValueError):
        R.publish(model(5), root, {}, version=9)
    R.publish(model(6), root, {})
    assert [r["hyperparameters"] for r in R.versions(spark, root).orderBy("version").collect()][:3] == ['{"a": 1}', '{"a": 2}', "{}"]
    assert len(glob.glob(f"{root}/*/model")) == 5


def test_broadcast_check_counts_strings_as_they_are(spark):
    big, small = spark.range(100), spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits_broadcast(small, limit=20_000) and not fits_broadcast(small, limit=9_000) and not fits_broadcast(small, 10, limit=9_000)
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(10), limit=100)
    arrays = spark.range(10).select(F.array_repeat(F.lit(1.0), 100).alias("a"))
    assert fits_broadcast(arrays, limit=20_000) and not fits_broadcast(arrays, limit=15_000)
    assert join_small(big, small, "id").count() == 10


def test_moments_cross_no_rows(spark):
    """Without medians no row is shuffled; one huge trip and NULL keys included; results equal the one-exchange plan."""
    from tripsense.operators.trip_aggregates import TripSpec
    from tripsense.plans import features as P

    rng = np.random.default_rng(2)
    rows = [(None if k % 9 == 0 else k % 4, float(k), float(rng.normal(1e6, 1)), float(rng.gamma(2))) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, t double, x double, y double")
    spec = TripSpec(key="k", order=("t",), channels=("x", "y"), signals=("x", "y"), time="t", families=("primitive", "kurtosis", "abs_mean", "trend"))
    wanted = tuple(n for n in P.output_names(spec) if not n.endswith("_median"))
    out = P.trip_features(df, spec, wanted=wanted, max_group_rows=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Repartition" not in plan and "percentile" not in plan
    other = P._normal_features(P.prepare(df, spec), spec).select("k", *wanted).toPandas().set_index("k").sort_index()
    got = out.toPandas().set_index("k").sort_index()
    assert len(got) == 5 and np.allclose(got[list(wanted)].to_numpy(float), other[list(wanted)].to_numpy(float), rtol=1e-9, equal_nan=True)


def test_embedded_labels(spark):
    """Features of a frame with a label column get the last label that is not NULL; without one they are as they are."""
    from tripsense.operators.trip_aggregates import TripSpec
    from tripsense.plans.features import trip_features, trip_features_labelled

    rows = [(1, 0.0, 1.0, 0), (1, 1.0, 2.0, 1), (1, 2.0, 4.0, None), (2, 0.0, 3.0, None), (3, 0.0, 1.0, 1), (3, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "k long, t double, x double, label int")
    spec = TripSpec(key="k", order=("t",), channels=("x",), signals=("x",), time="t", families=("abs_mean", "trend"))
    got = {r["k"]: r for r in trip_features_labelled(df, spec).collect()}
    assert {k: r["label"] for k, r in got.items()} == {1: 1, 2: None, 3: 0} and got[1]["x_abs_mean"] == 7 / 3
    plain = trip_features_labelled(df.drop("label"), spec)
    assert plain.columns == trip_features(df.drop("label"), spec).columns and plain.count() == 3
