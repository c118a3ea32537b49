"""Hilbert envelope mean (A14) of trips too large for one task: a distributed FFT.

For a trip of n samples the analytic signal is z = IDFT_n(DFT_n(x) * h) with
h = 1, 2, ..., 2, (1), 0, ..., 0; the feature is mean |z|. A bounded trip is
one array in one task (pandas UDF). A huge trip is transformed without ever
holding it in one place:

* **Bluestein (chirp-z)** turns a DFT of any length n into a circular
  convolution of length M = 2^k >= 2n - 1:
  X[k] = conj(w_k) * sum_j (x_j conj(w_j)) w_(k-j),  w_m = exp(i pi m^2 / n);
* the convolution is IFFT_M(FFT_M(a) * FFT_M(b)), and every FFT_M is a
  **four-step FFT**: M = M1 * M2 with both near sqrt(M); step 1 transforms
  M2 groups of M1 samples (``groupBy(key, t mod M2).applyInPandas``), applies
  the twiddles, step 2 transforms M1 groups of M2 samples. Each task holds
  about sqrt(M) values.

The padded index space 0..M-1 is generated row-locally (every sample spawns
the indices t + j n, j < 4, since M < 4n), so no task builds a long sequence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripsense.operators.keyed import join_small
from tripsense.operators.trip_aggregates import TripSpec, q

_CH = ("a", "b")  # two complex channels carried through every pass


def _schema(channels) -> T.StructType:
    fields = [T.StructField("k", T.StringType()), T.StructField("t", T.LongType()),
              T.StructField("n", T.LongType()), T.StructField("M", T.LongType()), T.StructField("M1", T.LongType())]
    for c in channels:
        fields += [T.StructField(f"{c}_re", T.DoubleType()), T.StructField(f"{c}_im", T.DoubleType())]
    return T.StructType(fields)


def _step1(channels):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        m, m1 = int(pdf["M"].iat[0]), int(pdf["M1"].iat[0])
        m2 = m // m1
        t2 = int(pdf["t"].iat[0]) % m2
        k1 = np.arange(m1, dtype=np.int64)
        tw = np.exp(-2j * np.pi * ((t2 * k1) % m) / m)
        out = pd.DataFrame({"k": pdf["k"].iat[0], "t": k1 * m2 + t2, "n": pdf["n"].iat[0], "M": m, "M1": m1})
        for c in channels:
            v = np.fft.fft(pdf[f"{c}_re"].to_numpy() + 1j * pdf[f"{c}_im"].to_numpy()) * tw
            out[f"{c}_re"], out[f"{c}_im"] = v.real, v.imag
        return out
    return fn


def _step2(channels):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        m, m1 = int(pdf["M"].iat[0]), int(pdf["M1"].iat[0])
        m2 = m // m1
        k1 = int(pdf["t"].iat[0]) // m2
        k2 = np.arange(m2, dtype=np.int64)
        out = pd.DataFrame({"k": pdf["k"].iat[0], "t": k1 + m1 * k2, "n": pdf["n"].iat[0], "M": m, "M1": m1})
        for c in channels:
            v = np.fft.fft(pdf[f"{c}_re"].to_numpy() + 1j * pdf[f"{c}_im"].to_numpy())
            out[f"{c}_re"], out[f"{c}_im"] = v.real, v.imag
        return out
    return fn


def distributed_fft(df: DataFrame, channels=_CH, inverse: bool = False) -> DataFrame:
    """FFT of length ``M`` (a power of two, per key) of every complex channel.

    ``df``: k (key as text), t (0..M-1, all present), n, M, M1, <c>_re, <c>_im.
    The inverse uses IFFT(v) = conj(FFT(conj(v))) / M.
    """
    schema = _schema(channels)
    if inverse:
        df = df.withColumns({f"{c}_im": -F.col(f"{c}_im") for c in channels})
    s1 = (df.withColumn("_g", F.col("t") % (F.col("M") / F.col("M1")).cast("long"))
          .groupBy("k", "_g").applyInPandas(_step1(channels), schema))
    s2 = (s1.withColumn("_g", F.floor(F.col("t") / (F.col("M") / F.col("M1"))).cast("long"))
          .groupBy("k", "_g").applyInPandas(_step2(channels), schema))
    if inverse:
        s2 = s2.withColumns({**{f"{c}_re": F.col(f"{c}_re") / F.col("M") for c in channels},
                             **{f"{c}_im": -F.col(f"{c}_im") / F.col("M") for c in channels}})
    return s2


def _chirp(t: str, n: str) -> tuple[str, str]:
    """cos/sin of pi (t^2 mod 2n) / n, with the square taken exactly in decimal arithmetic."""
    r = f"CAST(pmod(CAST({t} AS DECIMAL(38,0)) * CAST({t} AS DECIMAL(38,0)), 2 * {n}) AS DOUBLE)"
    ang = f"(pi() * {r} / {n})"
    return f"cos({ang})", f"sin({ang})"


def _bluestein_dft(values: DataFrame) -> DataFrame:
    """DFT of length n of (k, t, n, v_re, v_im), t in [0, n). Returns (k, t, n, X_re, X_im)."""
    # M = smallest power of two >= 2n - 1 (the log2 estimate is corrected by one step either way)
    est = "CAST(pow(2, ceil(log2(2 * n - 1))) AS BIGINT)"
    base = values.selectExpr("k", "t", "n", "v_re", "v_im", f"{est} AS _m0")
    base = base.selectExpr("k", "t", "n", "v_re", "v_im",
                           "CASE WHEN _m0 < 2 * n - 1 THEN 2 * _m0 WHEN _m0 >= 2 * (2 * n - 1) AND _m0 > 1 "
                           "THEN _m0 DIV 2 ELSE _m0 END AS M")
    base = base.selectExpr("*", "CAST(pow(2, ceil(round(log2(M)) / 2)) AS BIGINT) AS M1")
    # every sample spawns indices t + j n (j < 4); M < 4n, so 0..M-1 is covered exactly once
    idx = (base.selectExpr("*", "explode(sequence(0, 3)) AS _j")
           .selectExpr("k", "n", "M", "M1", "_j", "v_re", "v_im", "t + _j * n AS t")
           .filter("t < M"))
    cw, sw = _chirp("t", "n")
    tm = "(M - t)"
    cwm, swm = _chirp(tm, "n")
    padded = idx.selectExpr(
        "k", "t", "n", "M", "M1",
        # a = x conj(w) for t < n, else 0
        f"CASE WHEN _j = 0 THEN v_re * {cw} + v_im * {sw} ELSE 0.0 END AS a_re",
        f"CASE WHEN _j = 0 THEN v_im * {cw} - v_re * {sw} ELSE 0.0 END AS a_im",
        # b = w_t for t < n, w_(M-t) for t > M - n, else 0
        f"CASE WHEN t < n THEN {cw} WHEN t > M - n THEN {cwm} ELSE 0.0 END AS b_re",
        f"CASE WHEN t < n THEN {sw} WHEN t > M - n THEN {swm} ELSE 0.0 END AS b_im")
    spec = distributed_fft(padded)
    prod = spec.selectExpr("k", "t", "n", "M", "M1",
                           "a_re * b_re - a_im * b_im AS a_re", "a_re * b_im + a_im * b_re AS a_im")
    conv = distributed_fft(prod, channels=("a",), inverse=True).filter("t < n")
    return conv.selectExpr("k", "t", "n", f"a_re * {cw} + a_im * {sw} AS X_re", f"a_im * {cw} - a_re * {sw} AS X_im")


def hilbert_envelope_table(rows: DataFrame, key: str, pos: str, length: str, value: str) -> DataFrame:
    """Mean |analytic signal| per key from rows (key, position 0..n-1, n, value); NULL if a value is NULL."""
    k = rows.selectExpr(f"CAST({q(key)} AS STRING) AS k", f"{q(pos)} AS t", f"{q(length)} AS n",
                        f"CAST({q(value)} AS DOUBLE) AS v_re", "0D AS v_im")
    spec = _bluestein_dft(k)
    # h: 1 at 0 (and n/2 for even n), 2 on the positive frequencies, 0 on the negative ones
    h = "CASE WHEN t = 0 OR 2 * t = n THEN 1.0 WHEN 2 * t < n THEN 2.0 ELSE 0.0 END"
    # IDFT(Y) = conj(DFT(conj(Y))) / n
    y = spec.selectExpr("k", "t", "n", f"X_re * {h} AS v_re", f"-X_im * {h} AS v_im")
    z = _bluestein_dft(y).selectExpr("k", "X_re / n AS z_re", "-X_im / n AS z_im")
    env = z.groupBy(F.col("k").alias("_hk")).agg(F.avg(F.sqrt(F.col("z_re") ** 2 + F.col("z_im") ** 2)).alias("_env"))
    complete = rows.groupBy(key).agg((F.count(value) == F.count(F.lit(1))).alias("_ok"))
    # one row per hot trip on both sides
    return (join_small(complete.withColumn("_hk", F.col(key).cast("string")), env, "_hk", "left")
            .select(key, F.when(F.col("_ok"), F.col("_env")).alias("_env")))


def hilbert_hot(frame: DataFrame, spec: TripSpec) -> DataFrame:
    """``<s>_hilbert_mean`` of every signal for the trips of a hot frame (columns ``_i``, ``_n``)."""
    out = None
    for s in [s for s in spec.signals if spec.wants(f"{s}_hilbert_mean")]:
        t = hilbert_envelope_table(frame, spec.key, "_i", "_n", s).withColumnRenamed("_env", f"{s}_hilbert_mean")
        out = t if out is None else out.join(t, spec.key)
    return out
