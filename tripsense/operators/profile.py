"""Data profiling operators for data exploration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.operators.keyed import global_rank, join_small, prefix_sums
from tripsense.operators.trip_aggregates import q
from tripsense.session import materialize


def trip_lengths(df: DataFrame, key: str = S.KEY) -> DataFrame:
    """Rows per trip, longest first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key)


def length_profile(df: DataFrame, key: str = S.KEY) -> DataFrame:
    """count / mean / stddev / min / max of the rows per trip (A24, a typed ``describe``),
    as typed columns instead of strings."""
    lengths = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("trips"), F.avg("n").alias("mean_rows"),
                       F.stddev_samp("n").alias("stddev_rows"), F.min("n").alias("min_rows"),
                       F.max("n").alias("max_rows"))


def class_balance(labels: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Rows per label value."""
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def positive_count(labels: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Number of positive rows."""
    return labels.agg(F.count_if(F.col(label) == 1).alias("positives"))


def distinct_trips(df: DataFrame, key: str = S.KEY) -> DataFrame:
    """Distinct trips and total rows."""
    return df.agg(F.countDistinct(key).alias("trips"), F.count(F.lit(1)).alias("rows"))


def trips_from_start(df: DataFrame, key: str = S.KEY, time: str = S.SECOND) -> DataFrame:
    """Number of trips that have a sample at time 0 (A22 with the predicate of P6)."""
    return df.filter(F.col(time) == 0).agg(F.countDistinct(key).alias("trips_from_start"))


def trip_series(df: DataFrame, trip_id, key: str = S.KEY, order: Sequence[str] = (S.SECOND,),
                channels: Sequence[str] = S.RAW_CHANNELS) -> DataFrame:
    """All samples of one trip in time order (O3, O9); the key is compared as a number."""
    cols = [c for c in dict.fromkeys([*order, *channels])]
    return df.filter(F.col(key) == F.lit(trip_id)).select(key, *cols).orderBy(*order)


def longest_trip(df: DataFrame, key: str = S.KEY) -> DataFrame:
    """The key of the longest trip (ties: smallest key), as a one-row frame."""
    return trip_lengths(df, key).limit(1).select(key)


def labelled_trips_of_length(df: DataFrame, labels: DataFrame, rows: int = 120, value: int = 1, key: str = S.KEY,
                             label: str = S.LABEL) -> DataFrame:
    """Trips with label ``value`` and exactly ``rows`` rows."""
    chosen = labels.filter(F.col(label) == value).select(key).distinct()
    return df.join(chosen, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") == rows)


def histogram(features: DataFrame, columns: Sequence[str], bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histograms of many columns in one job.

    Bins span [min, max] of each column; the last bin is closed. Output:
    ``column, bin, lo, hi, count, density`` with density = count / (n width),
    the normalised (``normed=True``) form. NULLs are skipped.
    """
    features = materialize(features.selectExpr(*[q(c) for c in columns]))  # read by the ranges, their check and the counts
    structs = ", ".join(f"struct('{c}' AS column, CAST({q(c)} AS DOUBLE) AS x)" for c in columns)
    long = features.selectExpr(f"inline(array({structs}))").filter("x IS NOT NULL AND NOT isnan(x)")
    rng = materialize(long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                                 F.count(F.lit(1)).alias("n")))
    width = "(hi - lo) / {b}".format(b=bins)
    binned = (join_small(long, rng, "column")
              .selectExpr("column", "lo", "hi", "n",
                          f"CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) / ({width})) AS INT), {bins - 1}) END AS bin"))
    counts = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
                                                 F.first("hi").alias("hi"), F.first("n").alias("n"))
    return counts.selectExpr(
        "column", "bin",
        f"CASE WHEN hi = lo THEN lo ELSE lo + bin * ({width}) END AS bin_lo",
        f"CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * ({width}) END AS bin_hi",
        "count",
        f"CASE WHEN hi = lo THEN NULL ELSE count / (n * ({width})) END AS density")


def rank_experiments(experiments: DataFrame, id_col: str = "experiment_id",
                     value_cols: Sequence[str] = ("average_roc_auc_xgboost", "average_roc_auc_lightgbm")) -> DataFrame:
    """Unpivot the per-model AUC columns and rank all (experiment, model) runs (O10); ties share a rank.

    The ranks come from distributed running counts, not from one task's sort."""
    long = experiments.unpivot([id_col], list(value_cols), "model", "auc")
    better = global_rank(long.groupBy("auc").agg(F.count(F.lit(1)).alias("_runs")), [F.col("auc").desc()])
    ranked = prefix_sums(better, None, ["_rank"], ["_runs"])
    first = ranked.select("auc", (F.col("_cum__runs") - F.col("_runs") + 1).cast("int").alias("rank"))
    return (long.join(first, long["auc"].eqNullSafe(first["auc"])).select(id_col, "model", long["auc"], "rank"))
