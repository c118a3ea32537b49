"""Trip feature families against direct pandas / numpy definitions on hand-made trips."""

import math

import numpy as np
import pandas as pd
import pytest

from tripsense import schema as S
from tripsense.operators.trip_aggregates import TripSpec, hann_window, hilbert_envelope_mean
from tripsense.plans.features import mean_change_rate, output_names, trip_features, trip_last_n_long

SPEC = TripSpec(key="k", order=("t", "j"), channels=("x", "y"), signals=("x", "y"), time="t",
                windows=(3, 5), last_n=(2, 4, 10), quantiles=(0.01, 0.05, 0.95, 0.99))


def make_trips(seed=7):
    """T1-T6, T8, T9 of FIXTURES: sizes 1, 2, 3, 12 (constant y), 130 (gaps, ties in t), 95 (NaN in x),
    a trip with one time value, and trips of odd and even length."""
    rng = np.random.default_rng(seed)
    rows = []

    def add(k, n, const_y=False, nan_x=False, same_t=False):
        t = np.zeros(n) if same_t else np.sort(rng.choice(np.arange(4 * n + 5), n, replace=True)).astype(float)
        x = rng.normal(3, 2, n)
        y = np.full(n, 0.1) if const_y else rng.gamma(2.0, 1.5, n)
        if nan_x:
            x[rng.choice(n, 6, replace=False)] = np.nan
        for j in range(n):
            rows.append((k, float(t[j]), j, float(x[j]), float(y[j])))

    add(1, 1)
    add(2, 2)
    add(3, 3)
    add(4, 12, const_y=True)
    add(5, 130)
    add(6, 95, nan_x=True)
    add(8, 40, same_t=True)
    add(9, 51)
    add(10, 50)
    return pd.DataFrame(rows, columns=["k", "t", "j", "x", "y"])


def _expected(pdf: pd.DataFrame) -> pd.DataFrame:
    h = np.array(hann_window())
    out = []
    for k, g in pdf.sort_values(["k", "t", "j"]).groupby("k"):
        r = {"k": k}
        for c in ("x", "y"):
            s = g[c]
            r.update({f"{c}_min": s.min(), f"{c}_max": s.max(), f"{c}_mean": s.mean(), f"{c}_sum": s.sum(),
                      f"{c}_mad": (s - s.mean()).abs().mean(), f"{c}_skew": s.skew(), f"{c}_median": s.median(),
                      f"{c}_std": s.std(), f"{c}_kurt": s.kurt(), f"{c}_abs_mean": s.abs().mean()})
            v = s.to_numpy()
            ok = ~np.isnan(v)
            tt = g["t"].to_numpy()[ok]
            r[f"{c}_trend"] = 0.0 if len(set(tt)) <= 1 else np.polyfit(tt, v[ok], 1)[0]
            r[f"{c}_mean_change"] = np.nan if len(v) < 2 else np.mean(np.diff(v))
            n = len(v)
            r[f"{c}_hann_mean"] = np.mean(np.convolve(v, h, "full")[4:4 + n] / h.sum())
            r[f"{c}_hilbert_mean"] = np.nan if np.isnan(v).any() else hilbert_envelope_mean(v)
            for w in SPEC.windows:
                r[f"MA{w}_{c}_mean"] = s.rolling(w).mean().mean()
                r[f"MA{w}_{c}_std"] = s.rolling(w).std().std()
            r[f"{c}_iqr"] = s.quantile(0.75) - s.quantile(0.25)
            for q in SPEC.quantiles:
                r[S.quantile_name(q, c)] = s.quantile(q)
            desc = g.sort_values(["t", "j"], ascending=False)
            for m in SPEC.last_n:
                d = desc.head(m)[c]
                r.update({f"{c}_min_last_{m}_sec": d.min(), f"{c}_max_last_{m}_sec": d.max(),
                          f"{c}_mean_last_{m}_sec": d.mean(), f"{c}_std_last_{m}_sec": d.std(),
                          f"{c}_mad_last_{m}_sec": (d - d.mean()).abs().mean(), f"{c}_skew_last_{m}_sec": d.skew()})
                dv = d.to_numpy()
                r[f"{c}_mean_change_last_{m}_sec"] = np.nan if len(dv) < 2 else np.mean(np.diff(dv))
        out.append(r)
    return pd.DataFrame(out).set_index("k")


def _close(a, b, tol=1e-8):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return False
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def _compare(got: pd.DataFrame, exp: pd.DataFrame, cols):
    bad = []
    for k in exp.index:
        for c in cols:
            a, b = got.loc[k, c], exp.loc[k, c]
            a = None if a is None or (isinstance(a, float) and math.isnan(a)) else float(a)
            b = None if b is None or (isinstance(b, float) and math.isnan(b)) else float(b)
            if not _close(a, b):
                bad.append((k, c, a, b))
    assert not bad, bad[:10]


@pytest.fixture(scope="module")
def trips(spark):
    pdf = make_trips()
    return pdf, spark.createDataFrame(pdf)


def test_feature_contract_has_696_names():
    names = S.feature_names()
    assert len(names) == 696 and len(set(names)) == 696
    assert set(S.TOP_100_FEATURES) <= set(names) and len(S.TOP_100_FEATURES) == 100
    assert set(S.LOG1P_COLUMNS) <= set(names) and len(S.LOG1P_COLUMNS) == 104
    assert output_names(TripSpec()) == names


def test_all_families_match_pandas(trips):
    pdf, df = trips
    got = trip_features(df, SPEC).toPandas().set_index("k")
    exp = _expected(pdf)
    cols = [c for c in got.columns if c in exp.columns]
    assert len(cols) == len(output_names(SPEC))
    _compare(got, exp, cols)


def test_hot_path_equals_normal_path(trips):
    """Trips above max_group_rows go through range-partitioned positions and blocked windows."""
    pdf, df = trips
    spec = TripSpec(**{**SPEC.__dict__, "families": tuple(f for f in SPEC.families if f != "hilbert_hann")})
    normal = trip_features(df, spec).toPandas().set_index("k").sort_index()
    hot = trip_features(df, spec, max_group_rows=10, block_rows=16).toPandas().set_index("k").sort_index()
    _compare(hot, normal, list(normal.columns))


def test_shuffled_input_gives_same_result(trips, spark):
    pdf, df = trips
    base = trip_features(df, SPEC).toPandas().set_index("k").sort_index()
    shuffled = spark.createDataFrame(pdf.sample(frac=1.0, random_state=3)).repartition(7)
    again = trip_features(shuffled, SPEC).toPandas().set_index("k").sort_index()
    _compare(again, base, list(base.columns))


def test_constant_channel_edge_rules(trips):
    pdf, df = trips
    got = trip_features(df, SPEC).toPandas().set_index("k")
    assert got.loc[4, "y_skew"] == 0.0 and got.loc[4, "y_kurt"] == 0.0 and got.loc[4, "y_std"] == 0.0
    assert got.loc[4, "MA3_y_std"] == 0.0
    assert got.loc[4, "y_hann_mean"] < 0.1  # edge loss of the 'same' convolution
    assert pd.isna(got.loc[1, "x_std"]) and pd.isna(got.loc[2, "x_skew"]) and pd.isna(got.loc[3, "x_kurt"])
    assert got.loc[8, "x_trend"] == 0.0
    assert pd.isna(got.loc[6, "x_mean_change"]) and pd.isna(got.loc[6, "x_hilbert_mean"])


def test_last_n_long_layout(trips):
    pdf, df = trips
    long = trip_last_n_long(df, SPEC).toPandas()
    assert sorted(long["n"].unique()) == list(SPEC.last_n)
    assert len(long) == pdf["k"].nunique() * len(SPEC.last_n)


def test_mean_change_compat_is_mean_minus_key(trips):
    pdf, df = trips
    got = trip_features(df, SPEC, families=("mean_change",), mean_change="compat").toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        if g["x"].isna().any():
            assert pd.isna(got.loc[k, "x_mean_change"])
        else:
            assert _close(got.loc[k, "x_mean_change"], g["x"].mean() - k)


def test_mean_change_rate(trips):
    pdf, df = trips
    got = mean_change_rate(df, SPEC).toPandas().set_index("k")
    for k, g in pdf.sort_values(["k", "t", "j"]).groupby("k"):
        v = g["y"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            chg = np.diff(v) / v[:-1]
        chg = chg[np.isfinite(chg) & (chg != 0)]
        exp = chg.mean() if len(chg) else None
        assert _close(got.loc[k, "y_mean_change_rate"], exp)


def test_hot_path_hilbert_matches_numpy(trips):
    """The distributed (Bluestein + four-step) FFT path of huge trips equals numpy's FFT."""
    pdf, df = trips
    hot = trip_features(df, SPEC, families=("hilbert_hann",), max_group_rows=0).toPandas().set_index("k")
    exp = _expected(pdf)
    _compare(hot, exp, [c for c in hot.columns if c.endswith("_hilbert_mean")])


def test_requested_columns_only(trips):
    """trip_features_for builds only what is asked for and equals the full transform's columns."""
    from tripsense.plans.features import trip_features_for
    pdf, df = trips
    names = ["x_median", "y_iqr", S.quantile_name(0.95, "x"), "y_hilbert_mean", "x_mad_last_4_sec",
             "y_mean_change_last_2_sec", "MA5_x_std", "x_skew"]
    part = trip_features_for(df, names, SPEC).toPandas().set_index("k")
    assert list(part.columns) == names
    full = trip_features(df, SPEC).toPandas().set_index("k")
    _compare(part, full, names)


def test_mean_change_rate_hot_path(trips):
    pdf, df = trips
    normal = mean_change_rate(df, SPEC).toPandas().set_index("k").sort_index()
    hot = mean_change_rate(df, SPEC, max_group_rows=10).toPandas().set_index("k").sort_index()
    _compare(hot, normal, list(normal.columns))


def test_one_key_with_a_third_of_the_rows(trips, spark):
    """One hot trip (a third of all rows) beside normal trips: both paths, then their union."""
    pdf, _ = trips
    big = pdf[pdf["k"] == 5]
    rep = pd.concat([big.assign(j=big["j"] + 1000 * r, t=big["t"] + 600.0 * r) for r in range(2)])
    data = pd.concat([pdf, rep.assign(k=11)])
    share = (data["k"] == 11).mean()
    assert 0.3 < share < 0.5
    df = spark.createDataFrame(data)
    normal = trip_features(df, SPEC).toPandas().set_index("k").sort_index()
    mixed = trip_features(df, SPEC, max_group_rows=200, block_rows=64).toPandas().set_index("k").sort_index()
    _compare(mixed, normal, list(normal.columns))


def test_rolling_on_hot_trips_for_any_block_length(spark):
    """Blocks shorter than the widest window, as long and longer, on the real windows."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": np.repeat([1, 2], [400, 260]), "t": np.r_[np.arange(400.0), np.arange(260.0)], "j": 0,
                        "x": rng.normal(5, 2, 660), "y": np.r_[np.zeros(330), rng.gamma(2, 1, 330)]})
    df = spark.createDataFrame(pdf)
    spec = TripSpec(key="k", order=("t", "j"), channels=("x", "y"), signals=("x", "y"), time="t",
                    families=("rolling_mean", "rolling_std"))
    normal = trip_features(df, spec).toPandas().set_index("k").sort_index()
    g = pdf[pdf.k == 1].x
    assert _close(normal.loc[1, "MA90_x_mean"], g.rolling(90).mean().mean()) and _close(normal.loc[1, "MA60_x_std"], g.rolling(60).std().std())
    for rows, block in ((1, 1), (40, 40), (89, 89), (90, 90), (128, 128), (100, None)):
        hot = trip_features(df, spec, max_group_rows=rows, block_rows=block).toPandas().set_index("k").sort_index()
        _compare(hot, normal, list(normal.columns))


def test_rolling_keeps_its_digits_after_a_rough_start(spark):
    """City traffic, then a steady cruise with noise of 1e-5: windows equal the two-pass values."""
    from tripsense.operators.rolling import rolling_moments
    rng = np.random.default_rng(1)
    x = np.r_[rng.uniform(0, 30, 3600), 30 + rng.normal(0, 1e-5, 3600)]
    for w in (10, 90):
        want = np.array([x[i - w + 1:i + 1].std(ddof=1) if i >= w - 1 else np.nan for i in range(len(x))])
        got = np.sqrt(rolling_moments(x[:, None], np.array([0]), np.array([0]), w)[1][:, 0] / (w - 1))
        assert np.nanmax(np.abs(got / want - 1)) < 1e-6 and np.isnan(got[:w - 1]).all()
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.arange(3600.0), "j": 0, "x": x[3600:]}))
    spec = TripSpec(key="k", order=("t", "j"), channels=("x",), signals=("x",), time="t", families=("rolling_std",), windows=(10, 90))
    row = trip_features(df, spec).first()
    for w in (10, 90):
        want = np.array([x[3600:][i - w + 1:i + 1].std(ddof=1) for i in range(w - 1, 3600)]).std(ddof=1)
        assert abs(row[f"MA{w}_x_std"] / want - 1) < 1e-6


def test_light_families_shuffle_no_rows(spark, trips):
    _, df = trips
    import dataclasses
    for fam in ("trend", "abs_mean", "kurtosis", "mean_change"):
        plan = trip_features(df, dataclasses.replace(SPEC, families=(fam,)))._jdf.queryExecution().toString()
        assert "REPARTITION_BY_COL" not in plan and "Window" not in plan


def test_default_order_is_total(spark):
    """Ties in time: any input order gives one result."""
    rng = np.random.default_rng(9)
    n = 60
    pdf = pd.DataFrame({c: rng.normal(0, 1, n).round(2) for c in S.RAW_CHANNELS})
    pdf["second"] = np.repeat(np.arange(n // 3), 3).astype(float)
    pdf.insert(0, S.KEY, 1)
    fams = ("rolling_std", "mean_change", "last_n")
    runs = [trip_features(spark.createDataFrame(pdf.sample(frac=1, random_state=k)).repartition(k + 1), families=fams).toPandas() for k in range(3)]
    assert runs[0].equals(runs[1]) and runs[0].equals(runs[2])


def test_hot_quantiles_with_one_value_on_most_rows(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(3000) < 0.8, 0.0, rng.normal(10, 3, 3000))
    pdf = pd.DataFrame({"k": np.repeat([1, 2], 1500), "t": np.arange(3000.0), "j": 0, "x": x, "y": rng.integers(0, 3, 3000).astype(float)})
    spec = TripSpec(key="k", order=("t", "j"), channels=("x", "y"), signals=("x", "y"), time="t", families=("quantiles", "iqr", "primitive"))
    hot = trip_features(spark.createDataFrame(pdf), spec, max_group_rows=100).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for c in ("x", "y"):
            assert _close(hot.loc[k, f"{c}_median"], g[c].median()) and _close(hot.loc[k, f"q095_{c}"], g[c].quantile(0.95))
            assert _close(hot.loc[k, f"{c}_iqr"], g[c].quantile(0.75) - g[c].quantile(0.25))
