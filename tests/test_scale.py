"""What the work of feature queries and model fits grows with: scans, exchanges, partitions."""

import numpy as np
import pyarrow as pa
import pytest

from tripsense import schema as S
from tripsense.operators import profile as P
from tripsense.operators import trip_frame, trip_kernel
from tripsense.operators.trip_aggregates import TripSpec
from tripsense.plans import modeling as M
from tripsense.plans.features import trip_features
from tripsense.session import materialize


def telemetry(spark, lengths=(1, 2, 40, 130)):
    rng = np.random.default_rng(7)
    rows = [(key, *[None if rng.random() < 0.02 else float(v) for v in rng.normal(size=len(S.RAW_CHANNELS) - 1)], float(t))
            for key, n in enumerate(lengths) for t in range(n)]
    names = [c for c in S.RAW_CHANNELS if c != S.SECOND]
    return spark.createDataFrame(rows, f"{S.KEY} long, " + ", ".join(f"{c} double" for c in [*names, S.SECOND]))


def plain(row):
    return [float("nan") if x is None else x for x in row]


def test_all_features_take_one_exchange(spark):
    rows = materialize(telemetry(spark))
    out = trip_features(rows)
    assert len(out.columns) == 697 and out.count() == 4
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("MapInArrow") == 1


def test_trips_without_a_key_have_no_last_records(spark):
    rows = telemetry(spark, (5, 40)).selectExpr(f"nullif({S.KEY}, 0) AS {S.KEY}", *S.RAW_CHANNELS)
    got = {r[0]: r for r in trip_features(rows, families=("kurtosis", "trend", "last_n", "rolling_mean")).collect()}
    assert set(got) == {None, 1}
    later = [c for c in got[1].asDict() if "_last_" in c or c.startswith("MA")]
    assert all(got[None][c] is None for c in later) and got[1]["Speed_skew_last_30_sec"] is not None
    assert got[None]["Speed_trend"] is not None


def test_kernel_does_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = [5, 1, 37, 4, 64, 2]
    key = pa.array(np.repeat(np.arange(len(lengths)), lengths))
    spec = TripSpec(key="k", windows=(3, 10), last_n=(2, 10))
    data = {c: pa.array(rng.normal(size=len(key))) for c in spec.channels}
    table = pa.table({"k": key, **data})
    whole = pa.Table.from_batches(trip_kernel.TripKernel(spec)(table.to_batches()))
    monkeypatch.setattr(trip_kernel, "CHUNK_ROWS", 8)
    parts = pa.Table.from_batches(trip_kernel.TripKernel(spec)(table.to_batches(max_chunksize=3)))
    assert parts.column("k").to_pylist() == list(range(len(lengths)))
    for f in whole.column_names[1:]:
        for a, b in zip(whole.column(f).to_pylist(), parts.column(f).to_pylist()):
            assert plain(a) == pytest.approx(plain(b), nan_ok=True)


def test_histogram_computes_its_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    features = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b").mapInArrow(count, "a double, b double")
    rows = P.histogram(features, ["a", "b"], 5).collect()
    assert sum(r["count"] for r in rows) == 100 and seen.value == 50


def test_hot_moments_put_no_rows_in_order(spark, monkeypatch):
    rows = materialize(telemetry(spark))
    wanted = {r[0]: r for r in trip_features(rows, families=("primitive",)).collect()}

    def never(*a, **k):
        raise AssertionError("positions are not needed")

    monkeypatch.setattr(trip_frame, "ranked_positions", never)
    got = trip_features(rows, families=("primitive",), max_group_rows=1).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert plain(r) == pytest.approx(plain(wanted[r[0]]), rel=1e-9, abs=1e-12, nan_ok=True)


def test_training_data_lies_in_few_partitions(spark):
    table = materialize(spark.range(1000).repartition(64))
    assert M.gathered(table, 100).rdd.getNumPartitions() == 1
    assert M.gathered(table, 4000).rdd.getNumPartitions() == 4
