"""Column names, input schemas and the output-column contract of the trip features.

Every operator takes the key, ordering and channel names as arguments; the
defaults below are the telemetry names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names that must equal the reference's for compatible output.
# ---------------------------------------------------------------------------
KEY = "bookingID"
LABEL = "label"
SECOND = "second"
SPEED = "Speed"
TOTAL_ACC = "total_acceleration"
TOTAL_GYRO = "total_gyro"

# raw telemetry columns in CSV order, then the two norms
RAW_CHANNELS = (
    "Accuracy", "Bearing",
    "acceleration_x", "acceleration_y", "acceleration_z",
    "gyro_x", "gyro_y", "gyro_z",
    "second", "Speed",
)
CHANNELS = RAW_CHANNELS + (TOTAL_ACC, TOTAL_GYRO)
SIGNALS = (TOTAL_ACC, TOTAL_GYRO, SPEED)

PRIMITIVE_AGGS = ("min", "max", "mean", "sum", "mad", "skew", "median", "std")
LAST_N_AGGS = ("min", "max", "mean", "std", "mad", "skew")
LAST_N_VALUES = (10, 15, 30, 45, 60, 90, 120)
ROLLING_WINDOWS = (10, 30, 60, 90)
QUANTILES = (0.01, 0.05, 0.95, 0.99)
HANN_LENGTH = 10
LOG1P_SHIFT = 10.0
UNDER_SAMPLING_SEED = 999
KFOLD_SEED = 11
KFOLD_COUNT = 5
HOLDOUT_SEED = 999
HOLDOUT_FRACTION = 0.2
HISTOGRAM_BINS = 30

# The 104 columns of the (unused) log1p experiment.
LOG1P_COLUMNS = (
    "total_acceleration_kurt", "total_acceleration_abs_mean", "total_acceleration_hilbert_mean",
    "total_acceleration_hann_mean", "total_acceleration_std_last_10_sec",
    "total_acceleration_mad_last_10_sec", "total_acceleration_std_last_15_sec",
    "total_acceleration_mad_last_15_sec", "total_acceleration_std_last_30_sec",
    "total_acceleration_mad_last_30_sec", "total_gyro_max", "total_gyro_mean", "total_gyro_sum",
    "total_gyro_mad", "total_gyro_skew", "total_gyro_std", "total_gyro_kurt", "total_gyro_abs_mean",
    "total_gyro_hilbert_mean", "total_gyro_hann_mean", "total_gyro_max_last_10_sec",
    "total_gyro_mean_last_10_sec", "total_gyro_std_last_10_sec", "total_gyro_mad_last_10_sec",
    "total_gyro_max_last_15_sec", "total_gyro_mean_last_15_sec", "total_gyro_std_last_15_sec",
    "total_gyro_mad_last_15_sec", "total_gyro_max_last_30_sec", "total_gyro_mean_last_30_sec",
    "total_gyro_std_last_30_sec", "total_gyro_mad_last_30_sec", "total_gyro_max_last_45_sec",
    "total_gyro_mean_last_45_sec", "total_gyro_std_last_45_sec", "total_gyro_mad_last_45_sec",
    "total_gyro_max_last_60_sec", "total_gyro_mean_last_60_sec", "total_gyro_std_last_60_sec",
    "total_gyro_mad_last_60_sec", "total_gyro_max_last_90_sec", "total_gyro_mean_last_90_sec",
    "total_gyro_std_last_90_sec", "total_gyro_mad_last_90_sec", "total_gyro_max_last_120_sec",
    "total_gyro_mean_last_120_sec", "total_gyro_std_last_120_sec", "total_gyro_mad_last_120_sec",
    "Speed_min", "Speed_mean", "Speed_sum", "Speed_median", "Speed_hilbert_mean", "Speed_hann_mean",
    "Speed_min_last_10_sec", "Speed_max_last_10_sec", "Speed_mean_last_10_sec",
    "Speed_std_last_10_sec", "Speed_mad_last_10_sec", "Speed_min_last_15_sec", "Speed_max_last_15_sec",
    "Speed_mean_last_15_sec", "Speed_std_last_15_sec", "Speed_mad_last_15_sec",
    "Speed_min_last_30_sec", "Speed_max_last_30_sec", "Speed_mean_last_30_sec",
    "Speed_std_last_30_sec", "Speed_mad_last_30_sec", "Speed_min_last_45_sec", "Speed_min_last_60_sec",
    "Speed_min_last_90_sec", "Speed_min_last_120_sec", "Bearing_min", "Bearing_max", "Bearing_kurt",
    "Bearing_std_last_10_sec", "Bearing_mad_last_10_sec", "Bearing_min_last_10_sec",
    "Bearing_max_last_10_sec", "Bearing_std_last_15_sec", "Bearing_mad_last_15_sec",
    "Bearing_min_last_15_sec", "Bearing_max_last_15_sec", "Bearing_std_last_30_sec",
    "Bearing_mad_last_30_sec", "Bearing_min_last_30_sec", "Bearing_max_last_30_sec",
    "Bearing_std_last_45_sec", "Bearing_mad_last_45_sec", "Bearing_min_last_45_sec",
    "Bearing_max_last_45_sec", "Bearing_std_last_60_sec", "Bearing_mad_last_60_sec",
    "Bearing_min_last_60_sec", "Bearing_max_last_60_sec", "Bearing_std_last_90_sec",
    "Bearing_mad_last_90_sec", "Bearing_min_last_90_sec", "Bearing_max_last_90_sec",
    "Bearing_std_last_120_sec", "Bearing_mad_last_120_sec", "Bearing_min_last_120_sec",
    "Bearing_max_last_120_sec",
)

# The 100 model inputs, ordered by importance in the shipped model.
TOP_100_FEATURES = (
    "second_abs_mean", "second_median", "q099_total_gyro", "second_mean",
    "second_mean_last_10_sec", "second_min_last_10_sec", "Speed_hann_mean", "second_std",
    "second_max_last_10_sec", "total_acceleration_std", "second_max", "acceleration_y_mad",
    "second_mean_last_30_sec", "second_mad", "second_min_last_15_sec",
    "second_mad_last_15_sec", "acceleration_z_mad", "MA90_Speed_mean",
    "second_min_last_120_sec", "MA60_Speed_mean", "Accuracy_max_last_120_sec", "Bearing_std",
    "Speed_skew", "Speed_mean", "second_mad_last_60_sec", "Speed_iqr", "Bearing_mad",
    "q095_total_gyro", "total_gyro_mad_last_60_sec", "gyro_z_abs_mean",
    "second_std_last_60_sec", "total_gyro_max_last_90_sec", "Speed_max_last_120_sec",
    "Speed_median", "second_mad_last_10_sec", "acceleration_x_mad", "acceleration_y_mean",
    "total_gyro_mad_last_120_sec", "acceleration_x_std", "acceleration_y_abs_mean",
    "total_gyro_max_last_30_sec", "second_mad_last_30_sec", "gyro_y_max_last_30_sec",
    "total_acceleration_mean_change", "acceleration_z_max_last_60_sec", "MA10_total_gyro_std",
    "gyro_y_max", "Speed_mean_last_120_sec", "gyro_x_std", "second_min_last_90_sec",
    "Accuracy_max_last_10_sec", "gyro_x_mad", "gyro_y_mad_last_60_sec", "Speed_sum",
    "Speed_abs_mean", "Speed_max", "second_skew", "second_min_last_45_sec",
    "acceleration_y_median", "gyro_x_std_last_120_sec", "second_std_last_120_sec",
    "acceleration_z_std", "Bearing_min", "total_gyro_std_last_30_sec",
    "second_mad_last_120_sec", "acceleration_x_std_last_15_sec",
    "acceleration_z_std_last_45_sec", "total_acceleration_mean",
    "acceleration_y_std_last_10_sec", "acceleration_y_min_last_45_sec", "gyro_y_abs_mean",
    "acceleration_y_max_last_15_sec", "gyro_x_mad_last_90_sec",
    "acceleration_z_max_last_45_sec", "acceleration_x_mad_last_15_sec",
    "total_acceleration_mad_last_90_sec", "gyro_y_max_last_60_sec", "total_gyro_mean_change",
    "Speed_hilbert_mean", "Bearing_mad_last_10_sec", "Accuracy_median", "Speed_trend",
    "acceleration_x_std_last_30_sec", "second_std_last_15_sec", "gyro_y_mad_last_30_sec",
    "gyro_z_max_last_120_sec", "MA30_Speed_std", "second_std_last_90_sec",
    "Speed_mad_last_60_sec", "Speed_mean_last_15_sec", "second_sum",
    "total_gyro_hilbert_mean", "acceleration_y_mean_last_10_sec", "MA10_Speed_mean",
    "total_acceleration_mad_last_15_sec", "Bearing_max_last_15_sec",
    "Accuracy_min_last_15_sec", "MA60_Speed_std", "acceleration_z_max_last_120_sec",
    "Speed_std_last_45_sec",
)
# ---------------------------------------------------------------------------

TELEMETRY_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType(), False)]
    + [T.StructField(c, T.DoubleType(), True) for c in RAW_CHANNELS]
)
LABEL_SCHEMA = T.StructType([
    T.StructField(KEY, T.LongType(), False),
    T.StructField(LABEL, T.IntegerType(), True),
])
EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.IntegerType(), False),
    T.StructField("changes", T.StringType(), True),
    T.StructField("average_roc_auc_xgboost", T.DoubleType(), True),
    T.StructField("average_roc_auc_lightgbm", T.DoubleType(), True),
])


def quantile_name(q: float, channel: str) -> str:
    """``q0.01`` -> ``q001``: the template of the quantile block with dots removed."""
    return f"q{q}_{channel}".replace(".", "")


def primitive_names(channels=CHANNELS) -> list[str]:
    return [f"{c}_{a}" for c in channels for a in PRIMITIVE_AGGS]


def last_n_names(n: int, channels=CHANNELS, signals=SIGNALS) -> list[str]:
    names = [f"{c}_{a}_last_{n}_sec" for c in channels for a in LAST_N_AGGS]
    return names + [f"{s}_mean_change_last_{n}_sec" for s in signals]


def family_names(channels=CHANNELS, signals=SIGNALS) -> dict[str, list[str]]:
    """Output columns of every feature family, in the order of the full transform."""
    fam = {
        "primitive": primitive_names(channels),
        "kurtosis": [f"{c}_kurt" for c in channels],
        "abs_mean": [f"{c}_abs_mean" for c in channels],
        "trend": [f"{s}_trend" for s in signals],
        "mean_change": [f"{s}_mean_change" for s in signals],
        "hilbert_hann": [n for s in signals for n in (f"{s}_hilbert_mean", f"{s}_hann_mean")],
    }
    for n in LAST_N_VALUES:
        fam[f"last_{n}"] = last_n_names(n, channels, signals)
    fam["rolling_mean"] = [f"MA{w}_{s}_mean" for w in ROLLING_WINDOWS for s in signals]
    fam["rolling_std"] = [f"MA{w}_{s}_std" for w in ROLLING_WINDOWS for s in signals]
    fam["iqr"] = [f"{s}_iqr" for s in signals]
    fam["quantiles"] = [quantile_name(q, s) for q in QUANTILES for s in signals]
    return fam


def feature_names(channels=CHANNELS, signals=SIGNALS) -> list[str]:
    """The full output contract (696 names for the telemetry channels)."""
    return [n for names in family_names(channels, signals).values() for n in names]
