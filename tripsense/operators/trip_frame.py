"""Per-row frames of hot trips (more rows than ``max_group_rows``): telemetry rows plus the helper columns the aggregates read.

Exact positions come from :func:`ranked_positions`, trip means from a bounded per-key table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.operators.keyed import join_small, ranked_positions
from tripsense.operators.trip_aggregates import TripSpec, q
from tripsense.session import materialize


def _mean_channels(spec: TripSpec) -> list[str]:
    return list(spec.channels) if spec.moments else []


def _deviations(df: DataFrame, spec: TripSpec) -> DataFrame:
    if not spec.moments:
        return df
    return df.selectExpr("*", *[f"{q(c)} - _mean_{c} AS _d_{c}" for c in spec.channels])


def hot_frame(hot_rows: DataFrame, spec: TripSpec) -> DataFrame:
    """Frame for huge trips, computed without any per-trip task."""
    return _with_means(ranked_positions(hot_rows, spec.key, list(spec.order)), hot_rows, spec)


def unordered_frame(hot_rows: DataFrame, spec: TripSpec) -> DataFrame:
    """Frame for features of huge trips that need trip means but no positions: the rows are not put in order."""
    return _with_means(hot_rows, hot_rows, spec)


def _with_means(frame: DataFrame, hot_rows: DataFrame, spec: TripSpec) -> DataFrame:
    means = _mean_channels(spec)
    if means:
        table = hot_rows.groupBy(spec.key).agg(*[F.expr(f"avg({q(c)}) AS _mean_{c}") for c in means])
        frame = join_small(frame, materialize(table), spec.key)
    return _deviations(frame, spec)
