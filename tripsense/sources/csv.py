"""CSV sources and sinks of the batch job."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripsense import schema as S
from tripsense.functions.columns import nan_to_null
from tripsense.session import materialize

_WHOLE = (T.IntegerType, T.LongType)


def _first_lines(stop: bool):
    """Path and first line of every file that begins in a task. ``stop``: a task holds one file, its first lines suffice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            path, start = batch.column("path"), batch.column("start").to_numpy()
            runs = np.concatenate([[0], np.asarray(pc.run_end_encode(path).run_ends)[:-1]])
            first = pa.array([k for k in runs if start[k] == 0 and (k or path[0].as_py() != last)], pa.int64())
            yield pa.RecordBatch.from_arrays([path.take(first), batch.column("value").take(first)], ["path", "header"])
            if stop:
                return
            last = path[batch.num_rows - 1].as_py()
    return run


def headers(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, header`` of every file that is not empty, read by one Spark job; the driver opens no file.

    The cost of opening a file is set (in a session of its own) so that Spark gives each split of a file a task, which stops after
    its first lines. Should Spark have put several files into a task after all, the files are fewer than listed, and a
    second job reads on."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    lines = own.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    listed = own.read.format("binaryFile").load(pattern).filter("length > 0").count()  # lists, reads no content
    found = materialize(lines.mapInArrow(_first_lines(True), "path string, header string"))
    if found.count() != listed:
        found = materialize(lines.mapInArrow(_first_lines(False), "path string, header string"))
    return found.filter("header <> ''")


def _names(header: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in next(csv.reader([header.lstrip("\ufeff")])))


def _headers(spark: SparkSession, folder: str) -> dict[tuple, list[str]]:
    """The ``*.csv`` files of a folder by their header. Where all have the same one, the pattern stands for them, so no list
    of files comes to the driver."""
    pattern = f"{folder.rstrip('/')}/*.csv"
    try:
        found = headers(spark, pattern)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    kinds = [r["header"] for r in found.select("header").distinct().orderBy("header").collect()]
    groups: dict[tuple, list[str]] = {}
    for header in kinds:
        files = [pattern] if len(kinds) == 1 else [r["path"] for r in found.filter(F.col("header") == header).orderBy("path").collect()]
        groups.setdefault(_names(header), []).extend(files)
    return groups


def _whole_number(col: str, to: str) -> Column:
    """An integer column, read as text, that was written as ``1`` or ``1.0``; anything else is an error."""
    text = F.trim(F.col(col))
    x = F.expr(f"try_cast(`{col}` AS DECIMAL(38, 9))")
    bad = lambda what: F.raise_error(F.concat(F.lit(f"column {col} holds {what}: "), text)).cast(to)
    return (F.when(text.isNull() | F.lower(text).isin("", "nan"), F.lit(None)).when(x.isNull(), bad("no number"))
            .when(x == F.floor(x), x.cast(to)).otherwise(bad("a fraction")).alias(col))


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType | None = S.TELEMETRY_SCHEMA,
                    with_file_order: bool = False) -> DataFrame:
    """All ``*.csv`` files of a folder, read by the names in each file's header.

    Files with the same header are read together under an explicit schema (no inference pass, no
    drift between files) and united by name: columns may stand in any order, a missing column is
    NULL, an unknown one an error. Without a schema, types are inferred. NaN becomes NULL in
    double columns; integer columns (a key, a label) may be written as ``1.0``. ``with_file_order`` adds
    ``_file``, ``_block`` and ``_row`` (file name, start of the split, position within it), the
    ordinal the original relies on when it resolves repeated labels by file order.
    """
    parts = []
    groups = _headers(spark, folder)
    if not groups:
        raise FileNotFoundError(f"no CSV files with a header in {folder}")
    for header, files in groups.items():
        reader = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
        if schema is None:
            part = reader.option("inferSchema", True).csv(files)
        else:
            unknown = set(header) - set(schema.names)
            if unknown:
                raise ValueError(f"unknown columns {sorted(unknown)} in {files[0]}")
            loose = {f.name: T.StringType() if isinstance(f.dataType, _WHOLE) else f.dataType for f in schema.fields}
            part = reader.schema(T.StructType([T.StructField(n, loose[n], True) for n in header])).csv(files)
        if with_file_order:
            part = part.withColumns({"_file": F.col("_metadata.file_name"), "_block": F.col("_metadata.file_block_start"),
                                     "_row": F.monotonically_increasing_id()})
        doubles = [n for n, t in part.dtypes if t == "double"]
        whole = {f.name: f.dataType.simpleString() for f in schema.fields if isinstance(f.dataType, _WHOLE)} if schema is not None else {}
        parts.append(part.select(*[_whole_number(c, whole[c]) if c in whole else nan_to_null(c).alias(c) if c in doubles else F.col(c)
                                   for c in part.columns]))
    out = union_by_name(parts)
    if schema is not None:
        order = ["_file", "_block", "_row"] if with_file_order else []
        out = out.select(*[F.col(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in schema.fields], *order)
    return out


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """The experiment table, one CSV file (S3)."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(S.EXPERIMENT_SCHEMA).csv(path)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames, uniting columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_predictions(pred: DataFrame, path: str, key: str = S.KEY, single_file: bool = False) -> None:
    """``bookingID,probability`` CSV with a header (S4); ``single_file`` writes one part."""
    out = pred.select(key, "probability")
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """A frame as CSV with a header; one part file when ``single_file``."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
