"""The rolling kernel: any chunking of the rows gives the windows of pandas."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tripsense.operators import rolling as R

WINDOWS = (1, 3, 10, 30)


def trips(seed, key=lambda k: k):
    rng = np.random.default_rng(seed)
    frames = []
    for k, n in enumerate([1, 2, 9, 10, 11, 200, 64, 30, 31, 5]):
        x, y = rng.normal(5, 2, n), np.full(n, 0.1) if k % 3 else rng.gamma(2, 1, n)
        if k in (5, 7):
            x[rng.choice(n, 3, replace=False)] = np.nan
        frames.append(pd.DataFrame({"k": [key(k)] * n, "x": x, "y": y}))
    return frames


def walk(frames, sizes, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK_ROWS", chunk)
    table = pa.concat_tables([pa.Table.from_pandas(f, preserve_index=False) for f in frames], promote_options="permissive")
    batches, at = [], 0
    while at < table.num_rows:
        n = next(sizes)
        batches += table.slice(at, n).combine_chunks().to_batches()
        at += n
    out = [r for b in R.RollingKernel(WINDOWS, ["k"], ["x", "y"])(iter(batches)) for r in b.to_pylist()]
    return out


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_kernel_equals_pandas(monkeypatch, seed, chunk):
    rng = np.random.default_rng(seed)
    frames = trips(seed)
    out = walk(frames, iter(lambda: int(rng.integers(1, 40)), None), monkeypatch, chunk)
    assert [r["k"] for r in out] == list(range(len(frames)))
    for r, f in zip(out, frames):
        for k, (w, s) in enumerate((w, s) for w in WINDOWS for s in ("x", "y")):
            ma, sd = f[s].rolling(w).mean(), f[s].rolling(w).std()
            assert r["ma_n"][k] == ma.count() and r["sd_n"][k] == sd.count()
            if ma.count():
                assert abs(r["ma_mean"][k] - ma.mean()) < 1e-9
            if sd.count() and w > 1:
                assert abs(r["sd_mean"][k] - sd.mean()) < 1e-7 and abs(r["sd_m2"][k] - ((sd - sd.mean()) ** 2).sum()) < 1e-6


def test_constant_windows_are_exactly_zero(monkeypatch):
    frames = [pd.DataFrame({"k": 0, "x": np.r_[np.random.default_rng(3).uniform(0, 30, 100), np.full(200, 0.1)], "y": 0.3})]
    x = frames[0][["x", "y"]].to_numpy()
    _, m2 = R.rolling_moments(x, np.array([0]), np.array([0]), 10)
    assert (m2[109:, 0] == 0).all() and (m2[9:, 1] == 0).all() and (m2[9:100, 0] > 0).all()
    (row,) = walk(frames, iter(lambda: 37, None), monkeypatch, 20)
    assert row["sd_m2"][3] == 0 and row["sd_mean"][3] == 0  # y in windows of 3


@pytest.mark.parametrize("key", [lambda k: f"trip {k}", lambda k: None if k == 4 else k])
def test_keys_of_other_types_and_null(monkeypatch, key):
    frames = trips(4, key)
    out = walk(frames, iter(lambda: 13, None), monkeypatch, 25)
    assert [None if pd.isna(r["k"]) else r["k"] for r in out] == [key(k) for k in range(len(frames))]
    assert [r["ma_n"][1] for r in out] == [len(f) for f in frames]


def test_no_rows():
    assert list(R.RollingKernel(WINDOWS, ["k"], ["x"])(iter([]))) == []


def test_one_narrow_exchange(spark):
    from tripsense.operators.trip_aggregates import TripSpec
    from tripsense.plans.features import trip_features

    df = spark.createDataFrame([(1, float(t), float(t % 5), 0.5) for t in range(40)], "k long, t double, x double, other double")
    spec = TripSpec(key="k", order=("t",), channels=("x", "other"), signals=("x",), time="t", families=("rolling_mean", "rolling_std"), windows=(3,))
    plan = trip_features(df, spec)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and "Aggregate" not in plan
