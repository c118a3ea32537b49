"""``trip_features``: telemetry rows -> one wide feature row per trip.

Plan for bounded trips (the usual case)::

    scan -> project (NaN -> NULL, norms) -> Exchange hashpartitioning(key) -> Sort(key, order)
         -> trip kernel (one Arrow pass, one row of sums a trip) -> projections

so the rows cross the network once. Kurtosis, absolute mean, trend and mean change alone are plain partial
aggregates without any row exchange. Keys with more than ``max_group_rows``
rows are split off and processed by the hot path of
:mod:`tripsense.operators.trip_frame` and :mod:`tripsense.operators.quantiles`.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.functions.columns import nan_to_null, norm3
from tripsense.operators.hilbert import hilbert_hot
from tripsense.operators.keyed import DEFAULT_BLOCK_ROWS, DEFAULT_MAX_GROUP_ROWS, fits_broadcast, split_hot_keys
from tripsense.operators.lastn import last_n_long, last_n_outputs, last_n_wide, last_rows
from tripsense.operators.quantiles import percentile_table
from tripsense.operators.rolling import rolling_features, rolling_features_hot, rolling_outputs
from tripsense.operators.trip_aggregates import (
    TripSpec,
    kurtosis_sql,
    mean_change_sql,
    moment_aggs,
    moment_outputs,
    named,
    percentile_outputs,
    q,
    trend_sql,
    trip_aggs,
)
from tripsense.operators.trip_frame import hot_frame, unordered_frame
from tripsense.operators.trip_kernel import ROLLING, last_sums_sql, percentile_sql, signal_outputs, sums_sql, trip_sums
from tripsense.session import materialize

#: families that are partial aggregates of the rows as they are
LIGHT_FAMILIES = ("kurtosis", "abs_mean", "trend", "mean_change")

FAMILY_ORDER = ("primitive", "kurtosis", "abs_mean", "trend", "mean_change", "hilbert_hann",
                "last_n", "rolling_mean", "rolling_std", "iqr", "quantiles")


def output_names(spec: TripSpec) -> list[str]:
    """Output columns of ``spec`` in the order of the full transform."""
    fams = S.family_names(spec.channels, spec.signals)
    ordered = []
    for fam in sorted(spec.families, key=FAMILY_ORDER.index):
        if fam == "last_n":
            ordered += [n for k in spec.last_n for n in S.last_n_names(k, spec.channels, spec.signals)]
        elif fam == "rolling_mean":
            ordered += [f"MA{w}_{s}_mean" for w in spec.windows for s in spec.signals]
        elif fam == "rolling_std":
            ordered += [f"MA{w}_{s}_std" for w in spec.windows for s in spec.signals]
        elif fam == "quantiles":
            ordered += [S.quantile_name(q, s) for q in spec.quantiles for s in spec.signals]
        else:
            ordered += fams[fam]
    return ordered


def prepare(df: DataFrame, spec: TripSpec) -> DataFrame:
    """Project the key, ordering and channels; NaN -> NULL; add the norms if missing."""
    cols = set(df.columns)
    if S.TOTAL_ACC in spec.channels and S.TOTAL_ACC not in cols:
        df = df.withColumn(S.TOTAL_ACC, norm3("acceleration_x", "acceleration_y", "acceleration_z"))
    if S.TOTAL_GYRO in spec.channels and S.TOTAL_GYRO not in cols:
        df = df.withColumn(S.TOTAL_GYRO, norm3("gyro_x", "gyro_y", "gyro_z"))
    needed = [spec.key] + [c for c in spec.order if c not in spec.channels] + list(spec.channels)
    if spec.time not in needed:
        needed.append(spec.time)
    seen, proj = set(), []
    types = dict(df.dtypes)
    for c in needed:
        if c in seen:
            continue
        seen.add(c)
        if c in spec.channels or c == spec.time:
            proj.append(nan_to_null(F.col(c).cast("double")).alias(c) if types[c] in ("double", "float")
                        else F.col(c).cast("double").alias(c))
        else:
            proj.append(F.col(c))
    return df.select(*proj)


def _agg(frame: DataFrame, key: str, aggs: dict[str, str]) -> DataFrame:
    return frame.groupBy(key).agg(*[F.expr(e) for e in named(aggs)])


def _join_pieces(pieces: list[DataFrame], key: str) -> DataFrame:
    """Join per-key tables that share the hash partitioning of the key (no exchange)."""
    out = pieces[0]
    for p in pieces[1:]:
        out = out.join(p, key, "left")
    return out


def _normal_features(rows: DataFrame, spec: TripSpec) -> DataFrame:
    """Bounded trips: one hash exchange and one sort, one Arrow pass that leaves the sums of a trip, and projections of them."""
    if set(spec.families) <= {"rolling_mean", "rolling_std"}:
        return rolling_features(rows, spec)
    out = trip_sums(rows, spec)
    main = spec.moments or spec.percentile_channels() or spec.has("trend", "mean_change", "hilbert_hann")
    keyed = lambda e: f"CASE WHEN {q(spec.key)} IS NOT NULL THEN {e} END"
    if main and spec.rolling_windows:  # trips without a key have no rolling and last-n features beside others
        out = out.selectExpr(*[f"{keyed(c)} AS {c}" if c in ROLLING else q(c) for c in out.columns])
    steps = {**(sums_sql(spec) if spec.moments else {}), **percentile_sql(spec)}
    for n in spec.last_n if spec.has("last_n") else ():
        steps.update(last_sums_sql(spec, n))
    outputs = {**(moment_outputs(spec) if spec.moments else {}), **signal_outputs(spec), **percentile_outputs(spec, from_arrays=True)}
    for n in spec.last_n if spec.has("last_n") else ():
        outputs.update({name: keyed(e) if main or spec.rolling_windows else e for name, e in last_n_outputs(spec, n).items()})
    wanted = [e for name, e in zip(outputs, named(outputs)) if spec.wants(name)]
    rolling = rolling_outputs(spec) if spec.rolling_windows else []
    return out.selectExpr("*", *named(steps)).selectExpr(q(spec.key), *wanted, *rolling)


def _hot_features(rows: DataFrame, spec: TripSpec, block_rows: int) -> DataFrame:
    """Huge trips: positions from range partitioning, windows over bounded blocks; moments and percentiles alone need neither."""
    positions = not (spec.moments and set(spec.families) <= set(MOMENT_FAMILIES))
    frame = hot_frame(rows, spec) if positions else unordered_frame(rows, spec)
    pieces = []
    aggs = trip_aggs(spec, "_i" if positions else f"struct({spec.order_sql})")
    if aggs:
        main = _agg(frame, spec.key, aggs)
        if spec.moments:
            main = main.selectExpr("*", *named(moment_outputs(spec)))
        pieces.append(main)
    if spec.rolling_windows:
        pieces.append(rolling_features_hot(frame, spec, block_rows))
    if spec.has("last_n"):
        rows_rd = frame.filter(f"_n - _i <= {max(spec.last_n)}").selectExpr("*", "_n - _i AS _rd")
        pieces.append(last_n_wide(last_n_long(rows_rd, spec), spec))
    if spec.has("hilbert_hann") and any(spec.wants(f"{s}_hilbert_mean") for s in spec.signals):
        pieces.append(hilbert_hot(frame, spec))
    pct_channels = {c: spec.percentiles_of(c) for c in spec.percentile_channels()}
    if pct_channels:
        pieces.append(percentile_table(rows, spec.key, pct_channels))
    out = _join_pieces(pieces, spec.key)
    if pct_channels:
        out = out.selectExpr("*", *named(percentile_outputs(spec)))
    return out


def _light_features(rows: DataFrame, spec: TripSpec) -> DataFrame:
    """Families that need neither positions nor trip means: one partial aggregate, for keys of any size."""
    aggs = {}
    for c in spec.channels:
        if spec.has("kurtosis"):
            aggs[f"{c}_kurt"] = kurtosis_sql(c)
        if spec.has("abs_mean"):
            aggs[f"{c}_abs_mean"] = f"avg(abs({q(c)}))"
    order = f"struct({spec.order_sql})"
    for s in spec.signals:
        if spec.has("trend"):
            aggs[f"{s}_trend"] = trend_sql(s, spec.time)
        if spec.has("mean_change"):
            aggs[f"{s}_mean_change"] = mean_change_sql(spec, s, order)
    return _agg(rows, spec.key, aggs)


#: families that need trip means and values of channels, but no positions
MOMENT_FAMILIES = ("primitive", *LIGHT_FAMILIES, "iqr", "quantiles")


def _two_scan_features(rows: DataFrame, spec: TripSpec) -> DataFrame | None:
    """Moments without an exchange of rows: a first scan gives the trip means by a partial aggregate, a second one joins
    them back and adds up deviations (and value counts of percentiles) per trip in each task before anything is
    shuffled. None if the table of means is too large to broadcast: then one exchange of the rows is cheaper."""
    means = materialize(rows.groupBy(spec.key).agg(*[F.expr(f"avg({q(c)}) AS _mean_{c}") for c in spec.channels])
                        .withColumnRenamed(spec.key, "_of"))
    if not fits_broadcast(means):
        return None
    frame = rows.join(F.broadcast(means), F.col(spec.key).eqNullSafe(F.col("_of"))).drop("_of")
    frame = frame.selectExpr("*", *[f"{q(c)} - _mean_{c} AS _d_{c}" for c in spec.channels])
    aggs = moment_aggs(spec)
    order = f"struct({spec.order_sql})"
    for s in spec.signals:
        if spec.has("trend"):
            aggs[f"{s}_trend"] = trend_sql(s, spec.time)
        if spec.has("mean_change"):
            aggs[f"{s}_mean_change"] = mean_change_sql(spec, s, order)
    channels = {c: spec.percentiles_of(c) for c in spec.percentile_channels()}
    aggs.update({f"_pq_{c}": f"percentile({q(c)}, array({', '.join(repr(p) for p in ps)}))" for c, ps in channels.items()})
    out = _agg(frame, spec.key, aggs).selectExpr("*", *named(moment_outputs(spec)))
    return out.selectExpr("*", *named(percentile_outputs(spec, from_arrays=True))) if channels else out


def trip_features(df: DataFrame, spec: TripSpec | None = None, max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
                  block_rows: int | None = None, **spec_kwargs) -> DataFrame:
    """One row per trip: the key and the features of ``spec.families`` (all 696 by default).

    ``spec_kwargs`` override fields of ``spec`` (e.g. ``families=("trend",)``).
    The result does not depend on the input partitioning or row order.
    """
    spec = dataclasses.replace(spec or TripSpec(), **spec_kwargs)
    if spec.wanted:
        fams = [f for f in spec.families if set(output_names(dataclasses.replace(spec, families=(f,), wanted=())))
                & set(spec.wanted)]
        spec = dataclasses.replace(spec, families=tuple(fams))
    base = prepare(df, spec)
    names = [n for n in output_names(spec) if spec.wants(n)]
    if set(spec.families) <= set(LIGHT_FAMILIES):
        return _light_features(base, spec).select(spec.key, *names)
    two_scans = spec.moments and set(spec.families) <= set(MOMENT_FAMILIES)
    if two_scans and not spec.percentile_channels():  # for trips of any size
        out = _two_scan_features(base, spec)
        if out is not None:
            return out.select(spec.key, *names)
    normal, hot, _ = split_hot_keys(base, spec.key, max_group_rows)
    out = _two_scan_features(normal, spec) if two_scans and spec.percentile_channels() else None
    out = (out if out is not None else _normal_features(normal, spec)).select(spec.key, *names)
    if hot is not None:
        out = out.unionByName(_hot_features(hot, spec, block_rows or DEFAULT_BLOCK_ROWS).select(spec.key, *names))
    return out


def trip_features_labelled(df: DataFrame, spec: TripSpec | None = None, label: str = S.LABEL,
                           label_order: tuple = (), **kw) -> DataFrame:
    """B12 with an embedded label column (P11, N2): features plus the last non-NULL label per trip.

    When ``label`` is not a column of ``df`` this is :func:`trip_features`.
    """
    from tripsense.operators.labels import join_labels, last_label
    spec = spec or TripSpec()
    feats = trip_features(df.drop(label) if label in df.columns else df, spec, **kw)
    if label not in df.columns:
        return feats
    order = list(label_order) or list(spec.order)
    return join_labels(feats, last_label(df, spec.key, label, order), spec.key, label)


def trip_features_for(df: DataFrame, names=S.TOP_100_FEATURES, spec: TripSpec | None = None, **kw) -> DataFrame:
    """Only the listed feature columns (e.g. the 100 model inputs), in the given order.

    Families without a requested column are not built at all, and the packed
    or unpivoted intermediates (last-n, quantiles, Hilbert) carry only what is
    requested, unlike computing all 696 columns and cutting them afterwards.
    """
    spec = dataclasses.replace(spec or TripSpec(), wanted=tuple(names))
    return trip_features(df, spec, **kw).select(spec.key, *names)


def trip_last_n_long(df: DataFrame, spec: TripSpec | None = None, **spec_kwargs) -> DataFrame:
    """Last-n aggregates in the long layout: one row per (trip, n).

    The top-n filter runs as a partial group limit before the shuffle, so this
    path is safe for keys of any size without splitting.
    """
    spec = dataclasses.replace(spec or TripSpec(), families=("last_n",), **spec_kwargs)
    return last_n_long(last_rows(prepare(df, spec), spec), spec)


def mean_change_rate(df: DataFrame, spec: TripSpec | None = None, max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
                     **spec_kwargs) -> DataFrame:
    """Mean of the non-zero relative changes (x_i - x_{i-1}) / x_{i-1} per trip and signal.

    Not part of the 696 outputs (disabled in the original because a zero
    denominator gives infinity); here a zero denominator skips the step.
    """
    spec = dataclasses.replace(spec or TripSpec(), families=("mean_change",), **spec_kwargs)
    base = prepare(df, spec)
    normal, hot, _ = split_hot_keys(base, spec.key, max_group_rows)
    k = q(spec.key)

    def rates(frame: DataFrame, part: str, order: str) -> DataFrame:
        lags = [f"lag({q(s)}) OVER (PARTITION BY {part} ORDER BY {order}) AS _p_{s}" for s in spec.signals]
        chg = {s: f"(({q(s)} - _p_{s}) / nullif(_p_{s}, 0))" for s in spec.signals}
        aggs = {f"{s}_mean_change_rate": f"avg(CASE WHEN {c} <> 0 THEN {c} END)" for s, c in chg.items()}
        return _agg(frame.selectExpr("*", *lags), spec.key, aggs)

    out = rates(normal, k, spec.order_sql)
    if hot is not None:
        from tripsense.operators.keyed import block_with_halo, ranked_positions
        blocked = block_with_halo(ranked_positions(hot, spec.key, list(spec.order)), DEFAULT_BLOCK_ROWS, 1)
        hot_part = rates(blocked, f"{k}, _blk", "_i")
        # the halo row only serves as the predecessor of the block's first row
        out = out.unionByName(hot_part)
    return out
