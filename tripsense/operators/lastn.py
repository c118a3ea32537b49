"""Aggregates over the last n records of each trip.

"last n sec" means the last n *records* in trip order, not a time range.
All n values are handled in one pass: the last ``max(n)`` rows of every trip
are exploded into one copy per n they belong to and aggregated by
``(key, n)``; the wide layout pivots n back into columns.

Standalone, the top-n per key is a ``row_number() <= n`` filter, which Spark
plans as a partial ``WindowGroupLimit`` before the shuffle: at most n rows per
key leave each map task, so even a huge key only ships ``n x tasks`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.operators.trip_aggregates import (
    TripSpec,
    deviation_sums_sql,
    mean_change_sql,
    named,
    q,
    skew_sql,
    std_sql,
)


def last_rows(df: DataFrame, spec: TripSpec) -> DataFrame:
    """The last ``max(spec.last_n)`` records of every trip with ``_rd`` (1 = latest)."""
    desc = ", ".join(f"{q(c)} DESC" for c in spec.order)
    return (df.selectExpr("*", f"row_number() OVER (PARTITION BY {q(spec.key)} ORDER BY {desc}) AS _rd")
            .filter(f"_rd <= {max(spec.last_n)}"))


def last_n_long(rows: DataFrame, spec: TripSpec) -> DataFrame:
    """One row per (trip, n): min/max/mean/std/mad/skew per channel and the mean change
    of the signals over the last n records. ``rows`` carries ``_rd`` (1 = latest).

    The mean change walks the records latest-first (the sorted order of the
    original), so its sign is opposite to the whole-trip mean change.
    """
    k = q(spec.key)
    ns = ", ".join(str(n) for n in spec.last_n)
    ln = (rows.filter(f"_rd <= {max(spec.last_n)}")
          .selectExpr("*", f"explode(array({ns})) AS n")
          .filter("_rd <= n"))
    ln = ln.selectExpr("*", *[f"{q(c)} - avg({q(c)}) OVER (PARTITION BY {k}, n) AS _ld_{c}"
                              for c in spec.channels])
    aggs = {}
    for c in spec.channels:
        aggs.update(deviation_sums_sql(c, f"_ld_{c}", f"_l_{c}", order=3))
    for s in spec.signals:
        aggs[f"_mc_{s}"] = mean_change_sql(spec, s, pos="_rd")
    out = ln.groupBy(spec.key, "n").agg(*[F.expr(e) for e in named(aggs)])
    stats = _stats(spec, "_l_", "_mc_")
    return out.selectExpr(k, "n", *named(stats))


def _stats(spec: TripSpec, sums: str, change: str) -> dict[str, str]:
    """The statistics of the last records from their sums ``<sums><c>_<sum>`` and mean changes ``<change><s>``."""
    stats = {}
    for c in spec.channels:
        p = f"{sums}{c}"
        stats.update({f"{c}_min": f"{p}_min", f"{c}_max": f"{p}_max", f"{c}_mean": f"{p}_sx / {p}_n",
                      f"{c}_std": std_sql(p), f"{c}_mad": f"{p}_da / {p}_n", f"{c}_skew": skew_sql(p)})
    stats.update({f"{s}_mean_change": f"{change}{s}" for s in spec.signals})
    return stats


def last_n_outputs(spec: TripSpec, n: int) -> dict[str, str]:
    """The wide layout for one ``n`` from the columns of :func:`tripsense.operators.trip_kernel.last_sums_sql`."""
    stats = [f"{c}_{a}" for c in spec.channels for a in S.LAST_N_AGGS] + [f"{s}_mean_change" for s in spec.signals]
    found = _stats(spec, f"_l_{n}_", f"_mc_{n}_")
    return {name: found[stat] for name, stat in zip(S.last_n_names(n, spec.channels, spec.signals), stats)}


def last_n_wide(long: DataFrame, spec: TripSpec) -> DataFrame:
    """Pivot the long layout to ``<c>_<agg>_last_<n>_sec`` columns (one row per trip).

    One aggregate collects the (at most len(n)) rows of a trip into a map keyed
    by n; the names are then read out of it in one projection.
    """
    stats = [f"{c}_{a}" for c in spec.channels for a in S.LAST_N_AGGS] + [f"{s}_mean_change" for s in spec.signals]
    ns = [n for n in spec.last_n if any(spec.wants(m) for m in S.last_n_names(n, spec.channels, spec.signals))]
    used = [st for st in stats if any(spec.wants(f"{st}_last_{n}_sec") for n in ns)]
    long = long.filter(F.col("n").isin(ns))
    packed = long.groupBy(spec.key).agg(F.expr(
        "map_from_entries(collect_list(struct(n, struct(" + ", ".join(q(s) for s in used) + ")))) AS _ln"))
    cols = {}
    for n in spec.last_n:
        for name, stat in zip(S.last_n_names(n, spec.channels, spec.signals), stats):
            if spec.wants(name):
                cols[name] = f"_ln[{n}].{q(stat)}"
    return packed.selectExpr(q(spec.key), *named(cols))
