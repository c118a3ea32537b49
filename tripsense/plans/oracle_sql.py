"""Independent SQL (DuckDB dialect) for the registered queries: the correctness oracle.

The SQL recomputes every operator from the definitions (window functions,
``quantile_cont``, ``skewness``, a quadratic Hilbert kernel) over the same
table mapping as :mod:`tripsense.sources.tables`. Doubles are compared after
rounding to float32 precision on both sides (``norm``), since the engines
sum in different orders.
"""

from __future__ import annotations

from tripsense import schema as S
from tripsense.operators.trip_aggregates import hann_window
from tripsense.operators.sampling import seeded_order_sql

V1_KEY = "l_suppkey"
V1_ORDER = "second, l_orderkey, l_partkey, l_linenumber"
V2_KEY = "user_id"
V2_ORDER = "second, event_id"


def qd(name: str) -> str:
    return '"' + name + '"'


def norm(expr: str) -> str:
    """Comparison form of a double, identical in Spark SQL and DuckDB: float32 rounding,
    and magnitudes below 1e-12 (cancellation noise of exact zeros) as 0."""
    return f"(CASE WHEN abs({expr}) < 1e-12 THEN 0.0 ELSE CAST(CAST(({expr}) AS FLOAT) AS DOUBLE) + 0.0 END)"


V1_TRIPS = f"""raw AS (
  SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber,
    l_tax AS "Accuracy", l_extendedprice AS "Bearing",
    l_discount - CAST(0.05 AS DOUBLE) AS acceleration_x, l_tax - CAST(0.04 AS DOUBLE) AS acceleration_y,
    l_extendedprice / CAST(10000.0 AS DOUBLE) AS acceleration_z,
    l_tax AS gyro_x, l_discount AS gyro_y, l_quantity / CAST(10.0 AS DOUBLE) AS gyro_z,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS second,
    l_quantity AS "Speed"
  FROM lineitem),
trips AS (
  SELECT *, sqrt(acceleration_x * acceleration_x + acceleration_y * acceleration_y + acceleration_z * acceleration_z)
              AS total_acceleration,
            sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) AS total_gyro
  FROM raw)"""

V2_TRIPS = """ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, value FROM events),
trips AS (
  SELECT user_id, event_id, (us - min(us) OVER (PARTITION BY user_id)) / CAST(1000000.0 AS DOUBLE) AS second, value
  FROM ev)"""


def _skew(c: str) -> str:
    return f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END"


def _kurt(c: str) -> str:
    return f"CASE WHEN count({c}) < 4 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 ELSE kurtosis({c}) END"


def _select(key: str, cols: dict[str, str], body: str, group: str | None = None) -> str:
    sel = ",\n  ".join(f"{norm(e)} AS {qd(n)}" for n, e in cols.items())
    return f"SELECT {key},\n  {sel}\n{body}" + (f"\nGROUP BY {group}" if group else "")


# ------------------------------------------------------------------ families as CTE bodies
def primitive_cte(key: str, channels) -> str:
    means = ", ".join(f"avg({qd(c)}) AS m_{i}" for i, c in enumerate(channels))
    cols = {}
    for i, c in enumerate(channels):
        x = f"t.{qd(c)}"
        cols.update({f"{c}_min": f"min({x})", f"{c}_max": f"max({x})", f"{c}_mean": f"avg({x})",
                     f"{c}_sum": f"coalesce(sum({x}), 0.0)", f"{c}_mad": f"avg(abs({x} - m.m_{i}))",
                     f"{c}_skew": _skew(x), f"{c}_median": f"quantile_cont({x}, 0.5)",
                     f"{c}_std": f"stddev_samp({x})"})
    body = (f"FROM trips t JOIN (SELECT {key}, {means} FROM trips GROUP BY {key}) m USING ({key})")
    return _select(f"t.{key} AS {key}", cols, body, f"t.{key}")


def kurtosis_cte(key: str, channels) -> str:
    return _select(key, {f"{c}_kurt": _kurt(qd(c)) for c in channels}, "FROM trips", key)


def abs_mean_cte(key: str, channels) -> str:
    return _select(key, {f"{c}_abs_mean": f"avg(abs({qd(c)}))" for c in channels}, "FROM trips", key)


def trend_cte(key: str, signals, time: str = "second") -> str:
    cols = {f"{s}_trend": (f"CASE WHEN regr_count({qd(s)}, {time}) = 0 THEN NULL "
                           f"WHEN min({time}) = max({time}) THEN 0.0 ELSE regr_slope({qd(s)}, {time}) END")
            for s in signals}
    return _select(key, cols, "FROM trips", key)


def _ordered(key: str, order: str) -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i, "
            f"count(*) OVER (PARTITION BY {key}) AS n FROM trips)")


def mean_change_cte(key: str, order: str, signals, mode: str = "intent") -> str:
    if mode == "compat":
        cols = {f"{s}_mean_change": f"avg({qd(s)}) - CAST({key} AS DOUBLE)" for s in signals}
        return _select(key, cols, "FROM trips", key)
    cols = {f"{s}_mean_change": (f"CASE WHEN count(*) >= 2 THEN (max(CASE WHEN i = n - 1 THEN {qd(s)} END) "
                                 f"- max(CASE WHEN i = 0 THEN {qd(s)} END)) / (count(*) - 1) END") for s in signals}
    return _select(key, cols, f"FROM {_ordered(key, order)} o", key)


def mean_change_rate_cte(key: str, order: str, signals) -> str:
    lags = ", ".join(f"lag({qd(s)}) OVER (PARTITION BY {key} ORDER BY {order}) AS p_{i}" for i, s in enumerate(signals))
    cols = {f"{s}_mean_change_rate": (f"avg(CASE WHEN p_{i} <> 0 AND ({qd(s)} - p_{i}) / p_{i} <> 0 "
                                      f"THEN ({qd(s)} - p_{i}) / p_{i} END)") for i, s in enumerate(signals)}
    return _select(key, cols, f"FROM (SELECT *, {lags} FROM trips) o", key)


def hann_cte(key: str, order: str, signals) -> str:
    h = hann_window()
    prefix = [0.0]
    for v in h:
        prefix.append(prefix[-1] + v)
    arr = "[" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in prefix) + "]"
    lo, hi = "greatest(0, 4 - i)", "least(9, n - 1 + 4 - i)"
    w = (f"(CASE WHEN {hi} >= {lo} THEN (list_extract({arr}, CAST({hi} + 2 AS INTEGER)) "
         f"- list_extract({arr}, CAST({lo} + 1 AS INTEGER))) / CAST({prefix[-1]!r} AS DOUBLE) ELSE 0.0 END)")
    cols = {f"{s}_hann_mean": f"avg({qd(s)} * {w})" for s in signals}
    return _select(key, cols, f"FROM {_ordered(key, order)} o", key)


def hilbert_cte(key: str, order: str, signals) -> str:
    """Analytic-signal magnitude through the circular Hilbert kernel (quadratic self-join).

    With d = (i - j) mod n the kernel is 2/n cot(pi d / n) for odd d (n even, 0 for
    even d) and (cot(pi d / n) - (-1)^d / sin(pi d / n)) / n for d != 0 (n odd).
    """
    kern = ("CASE WHEN n % 2 = 0 THEN CASE WHEN d % 2 = 1 THEN 2.0 / n * cot(pi() * d / n) ELSE 0.0 END "
            "ELSE CASE WHEN d = 0 THEN 0.0 ELSE (cot(pi() * d / n) - (CASE WHEN d % 2 = 0 THEN 1.0 ELSE -1.0 END) "
            "/ sin(pi() * d / n)) / n END END")
    ax = ", ".join(f"a.{qd(s)} AS x_{i}, b.{qd(s)} AS y_{i}" for i, s in enumerate(signals))
    pairs = (f"SELECT a.{key} AS {key}, a.i AS i, a.n AS n, {ax}, ((a.i - b.i) % a.n + a.n) % a.n AS d "
             f"FROM {_ordered(key, order)} a JOIN {_ordered(key, order)} b ON a.{key} = b.{key}")
    qs = ", ".join(f"any_value(x_{i}) AS x_{i}, sum(y_{i} * ({kern})) AS q_{i}" for i in range(len(signals)))
    per_row = f"SELECT {key}, i, {qs} FROM ({pairs}) p GROUP BY {key}, i"
    cols = {f"{s}_hilbert_mean": f"avg(sqrt(x_{i} * x_{i} + q_{i} * q_{i}))" for i, s in enumerate(signals)}
    return _select(key, cols, f"FROM ({per_row}) h", key)


def last_n_long_sql(key: str, order: str, channels, signals, ns=S.LAST_N_VALUES) -> str:
    desc = ", ".join(f"{c.strip()} DESC" for c in order.split(","))
    vals = ", ".join(f"({n})" for n in ns)
    means = ", ".join(f"avg({qd(c)}) AS m_{i}" for i, c in enumerate(channels))
    cols = {}
    for i, c in enumerate(channels):
        x = f"e.{qd(c)}"
        cols.update({f"{c}_min": f"min({x})", f"{c}_max": f"max({x})", f"{c}_mean": f"avg({x})",
                     f"{c}_std": f"stddev_samp({x})", f"{c}_mad": f"avg(abs({x} - m.m_{i}))", f"{c}_skew": _skew(x)})
    for s in signals:
        cols[f"{s}_mean_change"] = (f"CASE WHEN count(*) >= 2 THEN (max(CASE WHEN e.rd = e.cnt THEN e.{qd(s)} END) "
                                    f"- max(CASE WHEN e.rd = 1 THEN e.{qd(s)} END)) / (count(*) - 1) END")
    e = (f"(SELECT r.*, nn.n, count(*) OVER (PARTITION BY r.{key}, nn.n) AS cnt FROM "
         f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {desc}) AS rd FROM trips) r "
         f"JOIN (VALUES {vals}) nn(n) ON r.rd <= nn.n)")
    body = (f"FROM {e} e JOIN (SELECT x.{key}, x.n, {means} FROM {e} x GROUP BY x.{key}, x.n) m "
            f"ON e.{key} = m.{key} AND e.n = m.n")
    sel = ",\n  ".join(f"{norm(v)} AS {qd(k)}" for k, v in cols.items())
    return f"SELECT e.{key} AS {key}, e.n AS n,\n  {sel}\n{body}\nGROUP BY e.{key}, e.n"


def rolling_cte(key: str, order: str, signals, kind: str, windows=S.ROLLING_WINDOWS) -> str:
    inner = []
    for w in windows:
        for i, s in enumerate(signals):
            frame = f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            f = "avg" if kind == "mean" else "stddev_samp"
            inner.append(f"CASE WHEN count({qd(s)}) OVER {frame} = {w} THEN {f}({qd(s)}) OVER {frame} END AS r_{w}_{i}")
    body = f"FROM (SELECT {key}, {', '.join(inner)} FROM trips) r"
    agg = "avg" if kind == "mean" else "stddev_samp"
    cols = {f"MA{w}_{s}_{kind}": f"{agg}(r_{w}_{i})" for w in windows for i, s in enumerate(signals)}
    return _select(key, cols, body, key)


def iqr_cte(key: str, signals) -> str:
    cols = {f"{s}_iqr": f"quantile_cont({qd(s)}, 0.75) - quantile_cont({qd(s)}, 0.25)" for s in signals}
    return _select(key, cols, "FROM trips", key)


def quantiles_cte(key: str, signals, qs=S.QUANTILES) -> str:
    cols = {S.quantile_name(p, s): f"quantile_cont({qd(s)}, {p})" for p in qs for s in signals}
    return _select(key, cols, "FROM trips", key)


def with_trips(select: str, trips: str = V1_TRIPS) -> str:
    """Prefix the trip CTEs; ``select`` may itself start with more CTEs (``name AS (...)``)."""
    sep = "\n" if select.lstrip().upper().startswith("SELECT") else ",\n"
    return f"WITH {trips}{sep}{select}"


def top_features_sql(names=S.TOP_100_FEATURES, key: str = V1_KEY, order: str = V1_ORDER) -> str:
    """All families joined on the key, then the fixed list of model inputs."""
    ch, sig = S.CHANNELS, S.SIGNALS
    parts = {
        "f_prim": primitive_cte(key, ch), "f_kurt": kurtosis_cte(key, ch), "f_abs": abs_mean_cte(key, ch),
        "f_trend": trend_cte(key, sig), "f_mc": mean_change_cte(key, order, sig),
        "f_hann": hann_cte(key, order, sig), "f_hil": hilbert_cte(key, order, sig),
        "f_rm": rolling_cte(key, order, sig, "mean"), "f_rs": rolling_cte(key, order, sig, "std"),
        "f_iqr": iqr_cte(key, sig), "f_q": quantiles_cte(key, sig),
    }
    ln = last_n_long_sql(key, order, ch, sig)
    pivot_cols = []
    for n in S.LAST_N_VALUES:
        for c in ch:
            for a in S.LAST_N_AGGS:
                pivot_cols.append(f"max(CASE WHEN n = {n} THEN {qd(f'{c}_{a}')} END) AS {qd(f'{c}_{a}_last_{n}_sec')}")
        for s in sig:
            pivot_cols.append(f"max(CASE WHEN n = {n} THEN {qd(f'{s}_mean_change')} END) "
                              f"AS {qd(f'{s}_mean_change_last_{n}_sec')}")
    parts["f_ln"] = f"SELECT {key}, {', '.join(pivot_cols)} FROM ({ln}) l GROUP BY {key}"
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    joins = " ".join(f"LEFT JOIN {name} USING ({key})" for name in list(parts)[1:])
    return f"WITH {V1_TRIPS},\n{ctes}\nSELECT {key}, {', '.join(qd(n) for n in names)} FROM f_prim {joins}"


def seeded(key: str, seed: int) -> str:
    return seeded_order_sql(key, seed)
