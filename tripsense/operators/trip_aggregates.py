"""Per-trip aggregate expressions of the feature families.

The expressions are SQL text, evaluated by one ``groupBy(key).agg`` over a
*trip frame*: the telemetry rows plus helper columns built by
:mod:`tripsense.operators.trip_frame`:

``_i`` 0-based position in the trip, ``_n`` trip length, ``_d_<c>`` deviation
of channel ``c`` from its trip mean ``_mean_<c>``. The rolling families come from
:mod:`tripsense.operators.rolling`.

Building expressions as text keeps the driver cheap: a projection of hundreds
of columns is one call into the JVM. Everything here runs in the JVM; only the
Hilbert envelope needs Python (a vectorised pandas UDF over one trip array).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tripsense import schema as S

ALL_FAMILIES = ("primitive", "kurtosis", "abs_mean", "trend", "mean_change", "hilbert_hann",
                "last_n", "rolling_mean", "rolling_std", "iqr", "quantiles")
MEAN_CHANGE_MODES = ("intent", "compat")


def q(name: str) -> str:
    """Quote an identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class TripSpec:
    """Names that bind the operators to a table.

    ``order`` must be a total order inside a trip (by default the time, ties broken by the other
    raw channels, so equal rows are the only ties left); every sequence feature (rolling, Hann, Hilbert, last-n, mean change) follows it.
    ``mean_change='intent'`` is the mean of successive differences;
    ``'compat'`` reproduces the original as run: ``mean(x) - key``.
    """
    key: str = S.KEY
    order: tuple = (S.SECOND, *(c for c in S.RAW_CHANNELS if c != S.SECOND))
    channels: tuple = S.CHANNELS
    signals: tuple = S.SIGNALS
    time: str = S.SECOND
    mean_change: str = "intent"
    last_n: tuple = S.LAST_N_VALUES
    windows: tuple = S.ROLLING_WINDOWS
    quantiles: tuple = S.QUANTILES
    families: tuple = field(default=ALL_FAMILIES)
    #: output columns actually needed (empty: all of ``families``); lets packed/unpivoted
    #: intermediates skip what Spark's column pruning cannot see through
    wanted: tuple = ()

    def __post_init__(self):
        if self.mean_change not in MEAN_CHANGE_MODES:
            raise ValueError(f"mean_change must be one of {MEAN_CHANGE_MODES}")
        unknown = set(self.families) - set(ALL_FAMILIES)
        if unknown:
            raise ValueError(f"unknown feature families: {sorted(unknown)}")
        missing = set(self.signals) - set(self.channels)
        if missing:
            raise ValueError(f"signals must be channels: {sorted(missing)}")

    def has(self, *fams: str) -> bool:
        return any(f in self.families for f in fams)

    @property
    def moments(self) -> bool:
        return self.has("primitive", "kurtosis", "abs_mean")

    @property
    def rolling_windows(self) -> tuple:
        return self.windows if self.has("rolling_mean", "rolling_std") else ()

    @property
    def order_sql(self) -> str:
        return ", ".join(q(c) for c in self.order)

    def wants(self, name: str) -> bool:
        return not self.wanted or name in self.wanted

    def percentiles_of(self, c: str) -> tuple:
        """Probabilities needed for channel ``c`` (median, IQR, quantiles), sorted."""
        ps = set()
        if self.has("primitive") and self.wants(f"{c}_median"):
            ps.add(0.5)
        if c in self.signals:
            if self.has("iqr") and self.wants(f"{c}_iqr"):
                ps.update((0.25, 0.75))
            if self.has("quantiles"):
                ps.update(p for p in self.quantiles if self.wants(S.quantile_name(p, c)))
        return tuple(sorted(ps))

    def percentile_channels(self) -> list[str]:
        return [c for c in self.channels if self.percentiles_of(c)]


# ---------------------------------------------------------------- Hann
def hann_window(length: int = S.HANN_LENGTH) -> list[float]:
    """Symmetric Hann window h[k] = 0.5 - 0.5 cos(2 pi k / (L - 1))."""
    return [0.5 - 0.5 * float(np.cos(2.0 * np.pi * k / (length - 1))) for k in range(length)]


def hann_weight_sql(i: str = "_i", n: str = "_n", length: int = S.HANN_LENGTH) -> str:
    """Weight of row ``i`` (0-based) of an ``n``-row trip in mean(convolve(x, h, 'same') / sum(h)).

    The 'same' output starts at offset c = (L-1)//2 of the full convolution, so
    row i meets h[k] for k in [max(0, c-i), min(L-1, n-1+c-i)]. The weight is a
    difference of prefix sums of h divided by sum(h); interior rows get 1.
    """
    h = hann_window(length)
    prefix = [0.0]
    for v in h:
        prefix.append(prefix[-1] + v)
    arr = "array(" + ", ".join(repr(p) for p in prefix) + ")"
    c = (length - 1) // 2
    lo = f"greatest(0, {c} - {i})"
    hi = f"least({length - 1}, {n} - 1 + {c} - {i})"
    return (f"(CASE WHEN {hi} >= {lo} THEN (element_at({arr}, CAST({hi} + 2 AS INT)) "
            f"- element_at({arr}, CAST({lo} + 1 AS INT))) / {prefix[-1]!r} ELSE 0.0 END)")


# ---------------------------------------------------------------- Hilbert
def hilbert_envelope_mean(x: np.ndarray) -> float | None:
    """Mean magnitude of the analytic signal (FFT over the whole trip, no padding)."""
    n = x.shape[0]
    if n == 0 or np.isnan(x).any():
        return None
    h = np.zeros(n)
    h[0] = 1.0
    if n % 2 == 0:
        h[n // 2] = 1.0
        h[1:n // 2] = 2.0
    else:
        h[1:(n + 1) // 2] = 2.0
    return float(np.abs(np.fft.ifft(np.fft.fft(x) * h)).mean())


@pandas_udf(T.DoubleType())
def hilbert_mean_udf(arrays: pd.Series) -> pd.Series:
    """Vectorised over a batch of trips: one ordered array per row."""
    return pd.Series([hilbert_envelope_mean(np.asarray(a, dtype="float64")) if a is not None else None
                      for a in arrays], dtype="float64")


# ---------------------------------------------------------------- aggregate builders (SQL text)
def _complete(c: str) -> str:
    """True when channel ``c`` has no NULL in the group."""
    return f"count({q(c)}) = count(1)"


def deviation_sums_sql(c: str, dev: str, prefix: str, order: int) -> dict[str, str]:
    """n, min, max, sum(x), sum|d|, sum d^1..d^order for d = deviation column ``dev``."""
    x, d = q(c), q(dev)
    out = {f"{prefix}_n": f"count({x})", f"{prefix}_min": f"min({x})", f"{prefix}_max": f"max({x})",
           f"{prefix}_sx": f"sum({x})", f"{prefix}_da": f"sum(abs({d}))",
           f"{prefix}_d1": f"sum({d})", f"{prefix}_d2": f"sum({d} * {d})"}
    if order >= 3:
        out[f"{prefix}_d3"] = f"sum({d} * {d} * {d})"
    if order >= 4:
        out[f"{prefix}_d4"] = f"sum({d} * {d} * {d} * {d})"
    return out


def central_sql(prefix: str) -> dict[str, str]:
    """Central sums about the exact mean from deviation sums about a reference m.

    With delta = S1/n:  M2 = S2 - n delta^2,  M3 = S3 - 3 delta S2 + 2 n delta^3,
    M4 = S4 - 4 delta S3 + 6 delta^2 S2 - 3 n delta^4.
    """
    n, s1, s2, s3, s4 = (f"CAST({prefix}_n AS DOUBLE)", f"{prefix}_d1", f"{prefix}_d2",
                         f"{prefix}_d3", f"{prefix}_d4")
    dl = f"({s1} / {n})"
    return {
        "n": n,
        "m2": f"greatest({s2} - {n} * {dl} * {dl}, 0.0)",
        "m3": f"({s3} - 3.0 * {dl} * {s2} + 2.0 * {n} * {dl} * {dl} * {dl})",
        "m4": f"({s4} - 4.0 * {dl} * {s3} + 6.0 * {dl} * {dl} * {s2} - 3.0 * {n} * {dl} * {dl} * {dl} * {dl})",
        "const": f"({prefix}_min = {prefix}_max)",
    }


def std_sql(prefix: str) -> str:
    c = central_sql(prefix)
    return f"(CASE WHEN {c['n']} >= 2 THEN sqrt({c['m2']} / ({c['n']} - 1)) END)"


def skew_sql(prefix: str) -> str:
    """pandas' bias-corrected G1 = g1 sqrt(n(n-1))/(n-2); NULL if n < 3; 0 if constant."""
    c = central_sql(prefix)
    n = c["n"]
    g1 = f"(sqrt({n}) * {c['m3']} / pow({c['m2']}, 1.5))"
    return (f"(CASE WHEN {n} < 3 THEN CAST(NULL AS DOUBLE) WHEN {c['const']} OR {c['m2']} = 0 THEN 0.0 "
            f"ELSE {g1} * sqrt({n} * ({n} - 1)) / ({n} - 2) END)")


def kurt_sql(prefix: str) -> str:
    """pandas' bias-corrected excess kurtosis G2; NULL if n < 4; 0 if constant."""
    c = central_sql(prefix)
    n = c["n"]
    g2 = f"({n} * {c['m4']} / ({c['m2']} * {c['m2']}) - 3.0)"
    return (f"(CASE WHEN {n} < 4 THEN CAST(NULL AS DOUBLE) WHEN {c['const']} OR {c['m2']} = 0 THEN 0.0 "
            f"ELSE ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * {g2} + 6.0) END)")


def kurtosis_sql(c: str) -> str:
    """The same G2 from Spark's own (population, partially aggregated) kurtosis g2."""
    x = q(c)
    n = f"CAST(count({x}) AS DOUBLE)"
    return (f"(CASE WHEN {n} < 4 THEN CAST(NULL AS DOUBLE) WHEN min({x}) = max({x}) THEN 0.0D "
            f"ELSE ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({x}) + 6.0D) END)")


def moment_aggs(spec: TripSpec) -> dict[str, str]:
    """Plain sums per channel for B1-B3 (deviations from the trip mean)."""
    order = 4 if spec.has("kurtosis") else 3
    out = {}
    for c in spec.channels:
        out.update(deviation_sums_sql(c, f"_d_{c}", f"_m_{c}", order))
        if spec.has("abs_mean"):
            out[f"_m_{c}_sa"] = f"sum(abs({q(c)}))"
    return out


def moment_outputs(spec: TripSpec) -> dict[str, str]:
    """B1 (except the median), B2, B3 from the sums of :func:`moment_aggs`."""
    out = {}
    for c in spec.channels:
        p = f"_m_{c}"
        if spec.has("primitive"):
            out[f"{c}_min"] = f"{p}_min"
            out[f"{c}_max"] = f"{p}_max"
            out[f"{c}_mean"] = f"{p}_sx / {p}_n"
            out[f"{c}_sum"] = f"coalesce({p}_sx, 0.0)"
            out[f"{c}_mad"] = f"{p}_da / {p}_n"
            out[f"{c}_skew"] = skew_sql(p)
            out[f"{c}_std"] = std_sql(p)
        if spec.has("kurtosis"):
            out[f"{c}_kurt"] = kurt_sql(p)
        if spec.has("abs_mean"):
            out[f"{c}_abs_mean"] = f"{p}_sa / {p}_n"
    return out


def trend_sql(y: str, x: str) -> str:
    """OLS slope of y on x with intercept (A11): 0 for a single distinct x, NULL without pairs."""
    return (f"(CASE WHEN regr_count({q(y)}, {q(x)}) = 0 THEN CAST(NULL AS DOUBLE) "
            f"ELSE coalesce(regr_slope({q(y)}, {q(x)}), 0.0) END)")


def mean_change_sql(spec: TripSpec, s: str, pos: str = "_i") -> str:
    """Mean of successive differences along ascending ``pos``: (last - first)/(n - 1).

    NULL when the group has fewer than 2 rows or any NULL sample. In mode
    ``compat`` it is ``mean(x) - key``, the original as run.
    """
    if spec.mean_change == "compat":
        return f"(CASE WHEN {_complete(s)} THEN avg({q(s)}) - CAST({q(spec.key)} AS DOUBLE) END)"
    return (f"(CASE WHEN {_complete(s)} AND count(1) >= 2 THEN "
            f"(max_by({q(s)}, {pos}) - min_by({q(s)}, {pos})) / (count(1) - 1) END)")


def trip_aggs(spec: TripSpec, pos: str = "_i") -> dict[str, str]:
    """Aggregates requested by ``spec``, except percentiles and trip arrays; ``pos`` orders the rows of a trip."""
    out = moment_aggs(spec) if spec.moments else {}
    if spec.has("trend"):
        out.update({f"{s}_trend": trend_sql(s, spec.time) for s in spec.signals})
    if spec.has("mean_change"):
        out.update({f"{s}_mean_change": mean_change_sql(spec, s, pos) for s in spec.signals})
    if spec.has("hilbert_hann"):
        w = hann_weight_sql()
        out.update({f"{s}_hann_mean": f"(CASE WHEN {_complete(s)} THEN avg({q(s)} * {w}) END)"
                    for s in spec.signals})
    return out


def percentile_value_sql(c: str, j: int, p: float) -> str:
    pos = f"((_pn_{c} - 1) * {p!r})"
    return (f"(CASE WHEN _phi_{c}_{j} IS NULL THEN _plo_{c}_{j} "
            f"ELSE _plo_{c}_{j} + (_phi_{c}_{j} - _plo_{c}_{j}) * ({pos} - floor({pos})) END)")


def percentile_outputs(spec: TripSpec, from_arrays: bool = False) -> dict[str, str]:
    """Median, IQR and quantile columns from the order statistics of
    :func:`tripsense.operators.quantiles.percentile_table` (hot trips) or, ``from_arrays``,
    from the ``_pq_<c>`` arrays of Spark's ``percentile`` aggregate (bounded trips)."""
    def at(c, p):
        j = spec.percentiles_of(c).index(p)
        return f"_pq_{c}[{j}]" if from_arrays else percentile_value_sql(c, j, p)
    out = {}
    if spec.has("primitive"):
        out.update({f"{c}_median": at(c, 0.5) for c in spec.channels if spec.wants(f"{c}_median")})
    if spec.has("iqr"):
        out.update({f"{s}_iqr": f"{at(s, 0.75)} - {at(s, 0.25)}" for s in spec.signals if spec.wants(f"{s}_iqr")})
    if spec.has("quantiles"):
        out.update({S.quantile_name(p, s): at(s, p) for p in spec.quantiles for s in spec.signals
                    if spec.wants(S.quantile_name(p, s))})
    return out


def named(exprs: dict[str, str]) -> list[str]:
    """``{name: sql}`` -> ``["sql AS `name`", ...]`` for ``selectExpr`` / ``F.expr``."""
    return [f"{sql} AS {q(name)}" for name, sql in exprs.items()]
