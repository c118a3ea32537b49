"""Views of the benchmark tables used as trips, labels and scores.

The benchmark has no telemetry, so its tables are mapped onto the telemetry
layout (the same mapping is used by the SQL oracle):

* ``lineitem`` as trips: key ``l_suppkey``, total order
  ``(l_shipdate, l_orderkey, l_partkey, l_linenumber)``, ``second`` = day number of
  ``l_shipdate`` since 1992-01-01, the other channels from price, discount,
  tax and quantity;
* ``events`` as trips: key ``user_id``, order ``ts`` (+ ``event_id``),
  ``second`` = seconds since the user's first event, signal ``value``;
* ``labels`` (``doc_id``, ``quality``) as trip labels; ``orders`` as a label log
  with repeats per ``o_custkey``; ``documents.n_chars`` as a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsense.operators.keyed import join_small
from tripsense.operators.trip_aggregates import TripSpec

LINEITEM_ORDER = ("second", "l_orderkey", "l_partkey", "l_linenumber")
LINEITEM_SPEC = TripSpec(key="l_suppkey", order=LINEITEM_ORDER)
EVENTS_SPEC = TripSpec(key="user_id", order=("second", "event_id"), channels=("second", "value"),
                       signals=("value",), time="second")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` in the telemetry layout (raw channels; the norms are derived later)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber",
        F.col("l_tax").alias("Accuracy"),
        F.col("l_extendedprice").alias("Bearing"),
        (F.col("l_discount") - F.lit(0.05)).alias("acceleration_x"),
        (F.col("l_tax") - F.lit(0.04)).alias("acceleration_y"),
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("acceleration_z"),
        F.col("l_tax").alias("gyro_x"),
        F.col("l_discount").alias("gyro_y"),
        (F.col("l_quantity") / F.lit(10.0)).alias("gyro_z"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("second"),
        F.col("l_quantity").alias("Speed"),
    )


def event_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trips of one signal, ``second`` counted from the user's first event."""
    ev = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = ev.groupBy("user_id").agg(F.min(us).alias("_t0"))  # one row per user, partial aggregate
    return (join_small(ev, first, "user_id")
            .select("user_id", "event_id", ((us - F.col("_t0")) / F.lit(1e6)).alias("second"), "value"))


def trip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels.quality`` keyed by ``doc_id`` (covers part of the trips)."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id"), F.col("quality").alias("label"))


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label log with repeats: one row per order, label 1 = 'F', 0 = 'O', NULL = 'P'."""
    o = table(spark, sf_dir, "orders")
    lab = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).cast("int")
    return o.select(F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey"), lab.alias("label"))
