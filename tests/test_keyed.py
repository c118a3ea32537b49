"""Distributed per-key positions and prefix sums when one key spans many range partitions."""

import numpy as np
import pandas as pd

from tripsense.operators.keyed import global_rank, prefix_sums, ranked_positions


def _skewed(spark, seed=5):
    rng = np.random.default_rng(seed)
    keys = np.r_[np.zeros(700, dtype=int), rng.integers(1, 40, 300)]  # key 0 holds 70 % of the rows
    pdf = pd.DataFrame({"k": keys, "t": rng.permutation(len(keys)), "v": rng.integers(0, 5, len(keys))})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_prefix_sums_match_cumsum(spark):
    pdf, df = _skewed(spark)
    got = prefix_sums(df, "k", ["t"], ["v"], partitions=7).toPandas().sort_values(["k", "t"])
    exp = pdf.sort_values(["k", "t"]).assign(c=lambda d: d.groupby("k")["v"].cumsum())
    assert got["_cum_v"].tolist() == exp["c"].tolist()


def test_ranked_positions_are_exact(spark):
    pdf, df = _skewed(spark)
    got = ranked_positions(df, "k", ["t"], partitions=7).toPandas().sort_values(["k", "t"])
    exp = pdf.sort_values(["k", "t"]).assign(i=lambda d: d.groupby("k").cumcount(),
                                             n=lambda d: d.groupby("k")["t"].transform("size"))
    assert got["_i"].tolist() == exp["i"].tolist() and got["_n"].tolist() == exp["n"].tolist()


def test_global_rank_is_a_permutation(spark):
    pdf, df = _skewed(spark)
    got = global_rank(df, ["v", "t"]).toPandas()
    assert sorted(got["_rank"]) == list(range(len(pdf)))
    assert (got.sort_values("_rank")[["v", "t"]].to_numpy() == pdf.sort_values(["v", "t"])[["v", "t"]].to_numpy()).all()
