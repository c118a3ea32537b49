"""

Every query reads the benchmark tables of ``sf_dir`` (mapped onto trips,
labels and scores by :mod:`tripsense.sources.tables`) over their whole
content. Doubles are rounded to float32 precision on both sides (``norm``)
because the two engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsense import schema as S
from tripsense.functions.columns import log1p_shift, select_prefix, with_norms
from tripsense.operators import evaluation as E
from tripsense.operators import profile as P
from tripsense.operators import sketches as K
from tripsense.operators.labels import duplicate_labels, join_labels, last_label
from tripsense.operators.sampling import holdout, kfold, under_sample
from tripsense.plans import oracle_sql as O
from tripsense.plans.features import mean_change_rate, trip_features, trip_features_for, trip_last_n_long
from tripsense.session import materialize
from tripsense.sources.csv import union_by_name
from tripsense.sources.tables import (
    EVENTS_SPEC,
    LINEITEM_SPEC,
    event_trips,
    label_log,
    lineitem_trips,
    table,
    trip_labels,
)

try:  # the training-data operators are optional: without the folder all other queries still work
    from tripsense.llm.queries import QUERIES as LLM_QUERIES
    from tripsense.llm.queries import SQL as LLM_SQL
except ImportError:
    LLM_QUERIES, LLM_SQL = {}, {}
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

SF_SMOKE = "/root/testdata/sf0.001"


def _norm(df: DataFrame) -> DataFrame:
    """float32-round every double column (same expression as the oracle's ``norm``)."""
    return df.selectExpr(*[O.norm(f"`{n}`") + f" AS `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes])


def _v1(spark, sf_dir):
    return lineitem_trips(spark, sf_dir)


def _family(*fams, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _norm(trip_features(_v1(spark, sf_dir), LINEITEM_SPEC, families=fams, **kw))
    return run


# ---------------------------------------------------------------------------------------------- queries
def q_vector_norm(spark, sf_dir):
    df = with_norms(_v1(spark, sf_dir))
    return _norm(df.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", S.TOTAL_ACC, S.TOTAL_GYRO))


def q_mean_change_rate(spark, sf_dir):
    return _norm(mean_change_rate(_v1(spark, sf_dir), LINEITEM_SPEC))


def q_hilbert(spark, sf_dir):
    out = trip_features(event_trips(spark, sf_dir), EVENTS_SPEC, families=("hilbert_hann",))
    return _norm(out.select("user_id", "value_hilbert_mean"))


def q_hann(spark, sf_dir):
    out = trip_features(_v1(spark, sf_dir), LINEITEM_SPEC, families=("hilbert_hann",))
    return _norm(out.select("l_suppkey", *[f"{s}_hann_mean" for s in S.SIGNALS]))


def q_last_n(spark, sf_dir):
    return _norm(trip_last_n_long(_v1(spark, sf_dir), LINEITEM_SPEC))


def q_features_top(spark, sf_dir):
    return _norm(trip_features_for(_v1(spark, sf_dir), S.TOP_100_FEATURES, LINEITEM_SPEC))


def q_last_label(spark, sf_dir):
    return last_label(label_log(spark, sf_dir), "o_custkey", "label", ["o_orderdate", "o_orderkey"])


def q_feature_label_join(spark, sf_dir):
    feats = trip_features(_v1(spark, sf_dir), LINEITEM_SPEC, families=("trend",))
    labels = trip_labels(spark, sf_dir).withColumnRenamed("doc_id", "l_suppkey")
    return _norm(join_labels(feats, labels, "l_suppkey", "label"))


def q_duplicate_labels(spark, sf_dir):
    return duplicate_labels(label_log(spark, sf_dir), "o_custkey")


def q_length_profile(spark, sf_dir):
    return _norm(P.length_profile(_v1(spark, sf_dir), "l_suppkey"))


def q_trip_lengths(spark, sf_dir):
    return P.trip_lengths(_v1(spark, sf_dir), "l_suppkey")


def q_class_balance(spark, sf_dir):
    return P.class_balance(trip_labels(spark, sf_dir), "label")


def q_positive_count(spark, sf_dir):
    return P.positive_count(trip_labels(spark, sf_dir), "label")


def q_distinct_trips(spark, sf_dir):
    return P.distinct_trips(_v1(spark, sf_dir), "l_suppkey")


def q_trips_from_start(spark, sf_dir):
    return P.trips_from_start(event_trips(spark, sf_dir), "user_id", "second")


def q_trip_series(spark, sf_dir):
    df = _v1(spark, sf_dir)
    longest = P.longest_trip(df, "l_suppkey").first()
    return _norm(P.trip_series(df, longest[0] if longest else None, "l_suppkey", LINEITEM_SPEC.order))


def q_labelled_length(spark, sf_dir):
    labels = trip_labels(spark, sf_dir).withColumnRenamed("doc_id", "l_suppkey")
    return P.labelled_trips_of_length(_v1(spark, sf_dir), labels, TRIP_ROWS, 1, "l_suppkey")


TRIP_ROWS = 614
HIST_COLS = [f"{c}_abs_mean" for c in S.CHANNELS]
#: the feature groups whose histograms the original draws
HIST_PREFIXES = ("total_acc", "total_gyro", "Speed", "Bearing")
HIST_ALL = [c for c in S.feature_names() if c.startswith(HIST_PREFIXES)]


def q_histogram(spark, sf_dir):
    feats = _norm(trip_features(_v1(spark, sf_dir), LINEITEM_SPEC, families=("abs_mean",)))
    return _norm(P.histogram(feats, HIST_COLS))


def q_histogram_all(spark, sf_dir):
    feats = select_prefix(_norm(trip_features_for(_v1(spark, sf_dir), HIST_ALL, LINEITEM_SPEC)), HIST_PREFIXES)
    return P.histogram(feats, HIST_ALL).select("column", "bin", "count")


def q_features_all(spark, sf_dir):
    return _norm(trip_features(_v1(spark, sf_dir), LINEITEM_SPEC))


def q_log1p(spark, sf_dir):
    feats = _norm(trip_features_for(_v1(spark, sf_dir), S.LOG1P_COLUMNS, LINEITEM_SPEC))
    return _norm(feats.select("l_suppkey", *[log1p_shift(c).alias(c) for c in S.LOG1P_COLUMNS]))


def q_union_files(spark, sf_dir):
    a = _v1(spark, sf_dir).select(F.col("l_suppkey").alias("trip"), "second", "Speed")
    b = event_trips(spark, sf_dir).select(F.col("user_id").alias("trip"), "second", "value")
    return _norm(union_by_name([a, b]))


def _doc_labels(spark, sf_dir, label="toxic"):
    return table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))


def q_under_sample(spark, sf_dir):
    return under_sample(_doc_labels(spark, sf_dir), "doc_id", "label", negative_ratio=2)


def q_kfold(spark, sf_dir):
    return kfold(_doc_labels(spark, sf_dir), "doc_id").select("doc_id", "fold")


def q_holdout(spark, sf_dir):
    return holdout(_doc_labels(spark, sf_dir), "doc_id").select("doc_id", "is_test")


def _scored_targets(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    long = lab.unpivot(["doc_id"], ["quality", "toxic"], "target", "y_true")
    return long.join(docs, "doc_id").select("doc_id", "target", F.col("y_true").cast("int").alias("y_true"),
                                            F.col("n_chars").cast("double").alias("y_pred"))


def q_roc_auc(spark, sf_dir):
    return _norm(E.roc_auc(_scored_targets(spark, sf_dir), group=["target"]))


def q_pr_auc(spark, sf_dir):
    return _norm(E.pr_auc(_scored_targets(spark, sf_dir), group=["target"]))


def q_cv_mean_auc(spark, sf_dir):
    scored = _scored_targets(spark, sf_dir).filter("target = 'quality'")
    folds = kfold(scored, "doc_id")
    return _norm(E.cv_mean_auc(folds))


def q_experiment_rank(spark, sf_dir):
    scored = _scored_targets(spark, sf_dir)
    folds = kfold(scored.filter("target = 'quality'").select("doc_id"), "doc_id")
    per = E.roc_auc(scored.join(folds, "doc_id"), group=["fold", "target"])
    exp = (per.groupBy("fold").pivot("target", ["quality", "toxic"]).agg(F.first("roc_auc"))
           .select((F.col("fold") + 1).alias("experiment_id"),
                   F.col("quality").alias("average_roc_auc_xgboost"),
                   F.col("toxic").alias("average_roc_auc_lightgbm")))
    return _norm(P.rank_experiments(exp))


def q_distinct_trips_sketch(spark, sf_dir):
    """Users from HLL sketches of each day, merged: within three standard errors of the exact count."""
    days = K.distinct_sketches(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["day"], "user_id")
    exact = table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("trips"))
    return K.merge_distinct_sketches(days).crossJoin(exact).select(  # two frames of one row
        "trips", (F.abs(F.col("estimate") - F.col("trips")) <= 3 * K.distinct_error(12) * F.col("trips")).alias("within"))


def q_quantiles_sketch(spark, sf_dir):
    """Quantiles from KLL sketches of each year, merged: per trip and quantile, whether its rank is within twice the error."""
    trips = with_norms(_v1(spark, sf_dir)).withColumn("year", F.floor(F.col("second") / 366))
    k = 400
    merged = K.merge_quantile_sketches(K.quantile_sketches(trips, ["l_suppkey", "year"], S.SIGNALS, k), ["l_suppkey"])
    long = K.sketched_quantiles(merged, ["l_suppkey"], S.SIGNALS).unpivot(
        ["l_suppkey"], [S.quantile_name(p, s) for p in S.QUANTILES for s in S.SIGNALS], "name", "value")
    names = F.create_map(*[F.lit(x) for p in S.QUANTILES for s in S.SIGNALS for x in (S.quantile_name(p, s), s)])
    shares = F.create_map(*[F.lit(x) for p in S.QUANTILES for s in S.SIGNALS for x in (S.quantile_name(p, s), float(p))])
    values = trips.select("l_suppkey", *S.SIGNALS).unpivot(["l_suppkey"], list(S.SIGNALS), "signal", "x")
    ranks = (values.join(long.withColumns({"signal": names[F.col("name")], "p": shares[F.col("name")]}), ["l_suppkey", "signal"])
             .groupBy("l_suppkey", "name", "p").agg(F.avg((F.col("x") < F.col("value")).cast("int")).alias("below"),
                                                  F.avg((F.col("x") <= F.col("value")).cast("int")).alias("upto")))
    off = 2 * K.rank_error(k)
    return ranks.select("l_suppkey", "name", F.col("p").between(F.col("below") - off, F.col("upto") + off).alias("within"))


def _model_table(spark, sf_dir):
    """The 100 model inputs of every trip, with the quality label where there is one."""
    feats = materialize(trip_features_for(_v1(spark, sf_dir), S.TOP_100_FEATURES, LINEITEM_SPEC))
    labels = trip_labels(spark, sf_dir).withColumnRenamed("doc_id", "l_suppkey")
    return feats, join_labels(feats, labels, "l_suppkey", "label").filter("label IS NOT NULL")


def _final_model(data):
    """Default parameters, rounds and patience of the batch job."""
    from tripsense.plans.modeling import fit_final
    return fit_final(data, S.TOP_100_FEATURES, {}, key="l_suppkey")[0]


def q_feature_importance(spark, sf_dir):
    from tripsense.plans.modeling import feature_importance
    top = feature_importance(_final_model(_model_table(spark, sf_dir)[1]), S.TOP_100_FEATURES, k=20)
    return spark.createDataFrame(top, "feature string, importance double")


def q_gbt_score(spark, sf_dir):
    from tripsense.plans.modeling import score
    feats, data = _model_table(spark, sf_dir)
    return score(_final_model(data), feats, S.TOP_100_FEATURES, key="l_suppkey")


def q_gbt_score_valid(spark, sf_dir):
    """Every trip has one score, a probability."""
    return q_gbt_score(spark, sf_dir).select("l_suppkey", F.col("probability").between(0, 1).alias("valid"))


PLANTED = "Speed_skew"


def q_gbt_planted_top(spark, sf_dir):
    """The feature that decides a planted label comes out as the most important one of the 100 inputs."""
    from tripsense.plans.modeling import feature_importance
    feats, _ = _model_table(spark, sf_dir)
    middle = feats.agg(F.percentile(PLANTED, F.lit(0.5))).first()[0]
    model = _final_model(feats.withColumn("label", (F.col(PLANTED) > middle).cast("int")))
    top = feature_importance(model, S.TOP_100_FEATURES, k=1)[0][0]
    return feats.groupBy(F.lit(top).alias("feature")).agg(F.count(F.lit(1)).alias("trips"))


HOT_ROWS = 100   # every lineitem trip exceeds this, so all take the hot path
HOT_BLOCK = 128  # rows per window block of a hot trip (several blocks per trip)
HOT_SMALL = 1    # a block shorter than the widest window: the operator widens it


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "vector_norm": q_vector_norm,
        "trip_primitive": _family("primitive"),
        "trip_kurtosis": _family("kurtosis"),
        "trip_abs_mean": _family("abs_mean"),
        "trip_trend": _family("trend"),
        "trip_mean_change_compat": _family("mean_change", mean_change="compat"),
        "trip_mean_change_intent": _family("mean_change"),
        "trip_mean_change_rate": q_mean_change_rate,
        "trip_hilbert_mean": q_hilbert,
        "trip_hann_mean": q_hann,
        "trip_last_n": q_last_n,
        "trip_rolling_mean": _family("rolling_mean"),
        "trip_rolling_std": _family("rolling_std"),
        # the distributed path for trips above max_group_rows, forced for every supplier
        # (527-695 rows each): range-partitioned positions, blocked windows, ranked quantiles
        "trip_primitive_hot": _family("primitive", max_group_rows=HOT_ROWS, block_rows=HOT_BLOCK),
        "trip_rolling_std_hot": _family("rolling_std", max_group_rows=HOT_ROWS, block_rows=HOT_BLOCK),
        "trip_rolling_mean_hot": _family("rolling_mean", max_group_rows=HOT_ROWS),
        "trip_rolling_std_hot_small": _family("rolling_std", max_group_rows=HOT_ROWS, block_rows=HOT_SMALL),
        "trip_quantiles_hot": _family("quantiles", max_group_rows=HOT_ROWS),
        "trip_features_all": q_features_all,
        "feature_histogram_all": q_histogram_all,
        "labelled_trips_of_length": q_labelled_length,
        "trip_iqr": _family("iqr"),
        "trip_quantiles": _family("quantiles"),
        "trip_features_top": q_features_top,
        "last_label": q_last_label,
        "feature_label_join": q_feature_label_join,
        "duplicate_labels": q_duplicate_labels,
        "trip_length_profile": q_length_profile,
        "trip_lengths": q_trip_lengths,
        "class_balance": q_class_balance,
        "positive_count": q_positive_count,
        "distinct_trips": q_distinct_trips,
        "trips_from_start": q_trips_from_start,
        "trip_series": q_trip_series,
        "feature_histogram": q_histogram,
        "log1p_transform": q_log1p,
        "union_files": q_union_files,
        "under_sample": q_under_sample,
        "kfold_sizes": q_kfold,
        "holdout_split": q_holdout,
        "roc_auc": q_roc_auc,
        "pr_auc": q_pr_auc,
        "cv_mean_auc": q_cv_mean_auc,
        "experiment_rank": q_experiment_rank,
        "feature_importance_topk": q_feature_importance,
        "distinct_trips_sketch": q_distinct_trips_sketch,
        "trip_quantiles_sketch": q_quantiles_sketch,
        "gbt_score": q_gbt_score,
        "gbt_score_valid": q_gbt_score_valid,
        "gbt_planted_top": q_gbt_planted_top,
        **LLM_QUERIES,
        **({"pipeline": corpus_pipeline.run} if corpus_pipeline else {}),
    }


# ---------------------------------------------------------------------------------------------- oracle SQL
def _auc_sql() -> str:
    return """scored AS (
  SELECT l.doc_id, u.target, CAST(u.y_true AS INTEGER) AS y_true, CAST(d.n_chars AS DOUBLE) AS y_pred
  FROM labels l
  JOIN (SELECT doc_id, 'quality' AS target, quality AS y_true FROM labels
        UNION ALL SELECT doc_id, 'toxic' AS target, toxic AS y_true FROM labels) u ON l.doc_id = u.doc_id
  JOIN documents d ON d.doc_id = l.doc_id),
pts AS (SELECT target, y_pred AS s, SUM(y_true) AS pos, COUNT(*) - SUM(y_true) AS neg FROM scored GROUP BY target, y_pred),
cum AS (SELECT *, SUM(pos) OVER (PARTITION BY target ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
                  SUM(neg) OVER (PARTITION BY target ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
                  SUM(pos) OVER (PARTITION BY target) AS P, SUM(neg) OVER (PARTITION BY target) AS N FROM pts)"""


def _roc_expr() -> str:
    return "SUM(pos * ((N - fp) + neg / 2.0)) / (ANY_VALUE(P) * ANY_VALUE(N))"


def _pr_expr() -> str:
    return ("SUM(CASE WHEN tp - pos < P THEN (tp / CAST(P AS DOUBLE) - (tp - pos) / CAST(P AS DOUBLE)) * "
            "(tp / CAST(tp + fp AS DOUBLE) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / "
            "CAST(tp - pos + fp - neg AS DOUBLE) ELSE 1.0 END) / 2.0 ELSE 0.0 END)")


def _fold_sql(key: str, table_sql: str, k: int = S.KFOLD_COUNT, seed: int = S.KFOLD_SEED) -> str:
    ordk = O.seeded(key, seed)
    return f"""(SELECT *, CAST(CASE WHEN r < (cnt % {k}) * (cnt // {k} + 1) THEN r // (cnt // {k} + 1)
        ELSE (cnt % {k}) + (r - (cnt % {k}) * (cnt // {k} + 1)) // (cnt // {k}) END AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY {ordk}, {key}) - 1 AS r, count(*) OVER () AS cnt FROM {table_sql}) x)"""


def oracle_sql() -> dict[str, str]:
    k1, o1 = O.V1_KEY, O.V1_ORDER
    ch, sig = S.CHANNELS, S.SIGNALS
    t = O.with_trips
    out = {
        "vector_norm": t(f"SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, {O.norm('total_acceleration')} AS total_acceleration, "
                         f"{O.norm('total_gyro')} AS total_gyro FROM trips"),
        "trip_primitive": t(O.primitive_cte(k1, ch)),
        "trip_kurtosis": t(O.kurtosis_cte(k1, ch)),
        "trip_abs_mean": t(O.abs_mean_cte(k1, ch)),
        "trip_trend": t(O.trend_cte(k1, sig)),
        "trip_mean_change_compat": t(O.mean_change_cte(k1, o1, sig, "compat")),
        "trip_mean_change_intent": t(O.mean_change_cte(k1, o1, sig)),
        "trip_mean_change_rate": t(O.mean_change_rate_cte(k1, o1, sig)),
        "trip_hilbert_mean": t(O.hilbert_cte(O.V2_KEY, O.V2_ORDER, ("value",)), O.V2_TRIPS),
        "trip_hann_mean": t(O.hann_cte(k1, o1, sig)),
        "trip_last_n": t(O.last_n_long_sql(k1, o1, ch, sig)),
        "trip_rolling_mean": t(O.rolling_cte(k1, o1, sig, "mean")),
        "trip_rolling_std": t(O.rolling_cte(k1, o1, sig, "std")),
        "trip_primitive_hot": t(O.primitive_cte(k1, ch)),
        "trip_rolling_std_hot": t(O.rolling_cte(k1, o1, sig, "std")),
        "trip_rolling_mean_hot": t(O.rolling_cte(k1, o1, sig, "mean")),
        "trip_rolling_std_hot_small": t(O.rolling_cte(k1, o1, sig, "std")),
        "trip_quantiles_hot": t(O.quantiles_cte(k1, sig)),
        "trip_features_all": O.top_features_sql(S.feature_names()),
        "feature_histogram_all": f"""WITH f AS ({O.top_features_sql(HIST_ALL)}),
long AS (UNPIVOT (SELECT * EXCLUDE (l_suppkey) FROM f) ON COLUMNS(*) INTO NAME col VALUE x),
rng AS (SELECT col, MIN(x) AS lo, MAX(x) AS hi FROM long GROUP BY col)
SELECT col AS "column", CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR((x - lo) / ((hi - lo) / 30)) AS INTEGER), 29) END AS bin,
  COUNT(*) AS count FROM long JOIN rng USING (col) GROUP BY 1, 2""",
        "labelled_trips_of_length": f"""SELECT l_suppkey, COUNT(*) AS count FROM lineitem
WHERE l_suppkey IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY l_suppkey HAVING COUNT(*) = {TRIP_ROWS}""",
        "trip_iqr": t(O.iqr_cte(k1, sig)),
        "trip_quantiles": t(O.quantiles_cte(k1, sig)),
        "trip_features_top": O.top_features_sql(),
        "last_label": """SELECT o_custkey, MAX(CASE WHEN rn = 1 THEN label END) AS label FROM (
  SELECT o_custkey, label, row_number() OVER (PARTITION BY o_custkey ORDER BY (label IS NULL), o_orderdate DESC,
         o_orderkey DESC) AS rn
  FROM (SELECT o_custkey, o_orderdate, o_orderkey,
               CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS INTEGER) AS label FROM orders) x) y
GROUP BY o_custkey""",
        "feature_label_join": t(f"SELECT f.*, l.quality AS label FROM ({O.trend_cte(k1, sig)}) f "
                                f"LEFT JOIN labels l ON f.l_suppkey = l.doc_id"),
        "duplicate_labels": "SELECT o_custkey, COUNT(*) AS count FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1",
        "trip_length_profile": f"""SELECT COUNT(*) AS trips, {O.norm('AVG(n)')} AS mean_rows, {O.norm('STDDEV_SAMP(n)')} AS stddev_rows,
  MIN(n) AS min_rows, MAX(n) AS max_rows FROM (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey) x""",
        "trip_lengths": "SELECT l_suppkey, COUNT(*) AS count FROM lineitem GROUP BY l_suppkey",
        "class_balance": "SELECT quality AS label, COUNT(*) AS count FROM labels GROUP BY quality",
        "positive_count": "SELECT COUNT(*) FILTER (WHERE quality = 1) AS positives FROM labels",
        "distinct_trips": "SELECT COUNT(DISTINCT l_suppkey) AS trips, COUNT(*) AS rows FROM lineitem",
        "trips_from_start": t("SELECT COUNT(DISTINCT user_id) AS trips_from_start FROM trips WHERE second = 0", O.V2_TRIPS),
        "trip_series": t(f"""SELECT l_suppkey, {O.norm('second')} AS second, l_orderkey, l_partkey, l_linenumber,
  {', '.join(f'{O.norm(O.qd(c))} AS {O.qd(c)}' for c in S.RAW_CHANNELS if c != 'second')}
FROM trips WHERE l_suppkey = (SELECT l_suppkey FROM trips GROUP BY l_suppkey ORDER BY COUNT(*) DESC, l_suppkey LIMIT 1)"""),
        "feature_histogram": t(f"""f AS ({O.abs_mean_cte(k1, ch)}),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {O.qd(c)} AS x FROM f" for c in HIST_COLS)}),
rng AS (SELECT col, MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n FROM long WHERE x IS NOT NULL GROUP BY col),
b AS (SELECT l.col, lo, hi, n, CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR((x - lo) / ((hi - lo) / 30)) AS INTEGER), 29) END AS bin
      FROM long l JOIN rng USING (col) WHERE x IS NOT NULL)
SELECT col AS "column", bin, {O.norm('CASE WHEN hi = lo THEN lo ELSE lo + bin * ((hi - lo) / 30) END')} AS bin_lo,
  {O.norm('CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 30) END')} AS bin_hi, COUNT(*) AS count,
  {O.norm('CASE WHEN hi = lo THEN NULL ELSE COUNT(*) / (n * ((hi - lo) / 30)) END')} AS density
FROM b GROUP BY col, bin, lo, hi, n"""),
        "union_files": t(f"""SELECT l_suppkey AS trip, {O.norm('second')} AS second, {O.norm('"Speed"')} AS "Speed", CAST(NULL AS DOUBLE) AS value FROM trips
UNION ALL SELECT user_id AS trip, {O.norm('second')} AS second, CAST(NULL AS DOUBLE) AS "Speed", {O.norm('value')} AS value FROM ev2""",
                         O.V1_TRIPS + ",\nev2 AS (SELECT user_id, (epoch_us(ts) - MIN(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(1000000.0 AS DOUBLE) AS second, value FROM events)"),
        "under_sample": f"""WITH d AS (SELECT doc_id, toxic AS label FROM labels),
p AS (SELECT COUNT(*) AS pc FROM d WHERE label = 1)
SELECT doc_id, label FROM d WHERE label = 1
UNION ALL
SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (ORDER BY {O.seeded('doc_id', S.UNDER_SAMPLING_SEED)}, doc_id) AS r
  FROM d WHERE label = 0) x WHERE r <= (SELECT pc * 2 FROM p)""",
        "kfold_sizes": f"SELECT doc_id, fold FROM {_fold_sql('doc_id', '(SELECT doc_id FROM labels)')} f",
        "holdout_split": f"""SELECT doc_id, r < CEIL(cnt * 0.2) AS is_test FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {O.seeded('doc_id', S.HOLDOUT_SEED)}, doc_id) - 1 AS r, COUNT(*) OVER () AS cnt
  FROM labels) x""",
        "roc_auc": f"WITH {_auc_sql()}\nSELECT target, {O.norm(_roc_expr())} AS roc_auc FROM cum GROUP BY target",
        "pr_auc": f"WITH {_auc_sql()}\nSELECT target, {O.norm(_pr_expr())} AS pr_auc FROM cum GROUP BY target",
        "distinct_trips_sketch": "SELECT COUNT(DISTINCT user_id) AS trips, true AS within FROM events",
        "trip_quantiles_sketch": f"""SELECT DISTINCT l_suppkey, name, true AS within FROM lineitem,
  (SELECT unnest([{', '.join(f"'{S.quantile_name(p, s)}'" for p in S.QUANTILES for s in S.SIGNALS)}]) AS name) n""",
        "gbt_score_valid": "SELECT DISTINCT l_suppkey, true AS valid FROM lineitem",
        "gbt_planted_top": f"SELECT '{PLANTED}' AS feature, COUNT(DISTINCT l_suppkey) AS trips FROM lineitem",
        "cv_mean_auc": f"""WITH folds AS (SELECT doc_id, fold FROM {_fold_sql('doc_id', '(SELECT doc_id FROM labels)')} f),
sc AS (SELECT f.fold, l.quality AS y_true, CAST(d.n_chars AS DOUBLE) AS s FROM labels l JOIN documents d USING (doc_id) JOIN folds f USING (doc_id)),
pts AS (SELECT fold, s, SUM(y_true) AS pos, COUNT(*) - SUM(y_true) AS neg FROM sc GROUP BY fold, s),
cum AS (SELECT *, SUM(neg) OVER (PARTITION BY fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
  SUM(pos) OVER (PARTITION BY fold) AS P, SUM(neg) OVER (PARTITION BY fold) AS N FROM pts),
per AS (SELECT fold, {_roc_expr()} AS auc FROM cum GROUP BY fold)
SELECT {O.norm('AVG(auc)')} AS mean_auc, COUNT(*) AS folds FROM per""",
        "experiment_rank": f"""WITH folds AS (SELECT doc_id, fold FROM {_fold_sql('doc_id', '(SELECT doc_id FROM labels)')} f),
{_auc_sql()},
sc AS (SELECT f.fold, s.target, s.y_true, s.y_pred FROM scored s JOIN folds f USING (doc_id)),
p2 AS (SELECT fold, target, y_pred AS s, SUM(y_true) AS pos, COUNT(*) - SUM(y_true) AS neg FROM sc GROUP BY fold, target, y_pred),
c2 AS (SELECT *, SUM(neg) OVER (PARTITION BY fold, target ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
  SUM(pos) OVER (PARTITION BY fold, target) AS P, SUM(neg) OVER (PARTITION BY fold, target) AS N FROM p2),
per AS (SELECT fold, target, CASE WHEN ANY_VALUE(P) > 0 AND ANY_VALUE(N) > 0 THEN {_roc_expr()} END AS auc FROM c2 GROUP BY fold, target),
runs AS (SELECT fold + 1 AS experiment_id, CASE target WHEN 'quality' THEN 'average_roc_auc_xgboost' ELSE 'average_roc_auc_lightgbm' END AS model, auc FROM per)
SELECT experiment_id, model, {O.norm('auc')} AS auc, CAST(rank() OVER (ORDER BY auc DESC NULLS LAST) AS INTEGER) AS rank FROM runs""",
    }
    out["log1p_transform"] = f"WITH f AS ({O.top_features_sql(S.LOG1P_COLUMNS)})\nSELECT l_suppkey, " + ", ".join(
        f"{O.norm(f'CASE WHEN {O.qd(c)} + 10 > -1 THEN ln(1 + {O.qd(c)} + 10) END')} AS {O.qd(c)}" for c in S.LOG1P_COLUMNS) + " FROM f"
    out.update(LLM_SQL)
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out


# ---------------------------------------------------------------------------------------------- flagship
def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the full 696-feature transform of the sf0.001 trips (one row per trip)."""
    return trip_features(lineitem_trips(spark, SF_SMOKE), LINEITEM_SPEC)
