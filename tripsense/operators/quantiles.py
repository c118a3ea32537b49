"""Exact per-key quantiles with linear interpolation (A7, A16, A17), for huge keys.

Bounded keys use Spark's exact ``percentile`` aggregate. A huge key cannot be held in one
buffer, so its values are first counted (a value that fills most of a trip, such as the speed
of a parked vehicle, collapses on the map side), and running sums of the counts over a range
partitioning on ``(key, channel, value)`` give the positions each value covers. Only the two
neighbouring order statistics of every requested probability are kept.

The output columns are those that
:func:`tripsense.operators.trip_aggregates.percentile_outputs` reads
(``_pn``/``_plo``/``_phi``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.operators.keyed import prefix_sums
from tripsense.operators.trip_aggregates import named, q


def percentile_table(df: DataFrame, key: str, channels: dict[str, Sequence[float]]) -> DataFrame:
    """``key`` + ``_pn_<c>``, ``_plo_<c>_<j>``, ``_phi_<c>_<j>`` for every channel and probability.

    NULL samples are skipped (as pandas does); n counts the non-null ones.
    """
    names = list(channels)
    structs = ", ".join(f"struct({i} AS _ch, CAST({q(c)} AS DOUBLE) AS _x)" for i, c in enumerate(names))
    stacked = df.selectExpr(q(key), f"inline(array({structs}))").filter("_x IS NOT NULL")
    counts = stacked.groupBy(key, "_ch", "_x").agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(counts, [key, "_ch"], ["_x"], ["_c"], totals=True).withColumnRenamed("_all__c", "_n")

    def covers(pos: str) -> str:
        return f"({pos} >= _cum__c - _c AND {pos} < _cum__c)"

    aggs = {}
    for i, (c, ps) in enumerate(channels.items()):
        aggs[f"_pn_{c}"] = f"max(CASE WHEN _ch = {i} THEN _n END)"
        for j, p in enumerate(ps):
            lo = f"floor((_n - 1) * {p!r})"
            aggs[f"_plo_{c}_{j}"] = f"max(CASE WHEN _ch = {i} AND {covers(lo)} THEN _x END)"
            aggs[f"_phi_{c}_{j}"] = f"max(CASE WHEN _ch = {i} AND {covers(f'({lo} + 1)')} THEN _x END)"
    return ranked.groupBy(key).agg(*[F.expr(e) for e in named(aggs)])
