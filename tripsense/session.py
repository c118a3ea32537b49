"""SparkSession and checkpoint-directory helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints of intermediate frames are removed once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "tripsense", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and a UTC clock.

    ``master`` is only set when given: on a cluster ``spark-submit`` decides it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only when it is unset (local tests) a private folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(checkpoints must survive the loss of an executor)")
        conf_dir = tempfile.mkdtemp(prefix="tripsense-ckpt-")  # local mode only (tests)
    path = sc._jvm.org.apache.hadoop.fs.Path(conf_dir)
    if (not sc.master.startswith("local") and "://" not in conf_dir and not conf_dir.startswith("file:")
            and path.getFileSystem(sc._jsc.hadoopConfiguration()).getScheme() == "file"):
        raise RuntimeError(f"{conf_dir} would be a local folder of each machine; name a shared one with its scheme")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    Used where a result feeds several plans or where recomputation after an
    executor loss would be costly or order-sensitive.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
