"""Grouped building blocks that stay balanced when one key is huge.

Trips are normally short (minutes to hours of 1 Hz samples), so per-key
windows are cheap. But one key may hold a large share of all rows. Every
per-key operator therefore splits the input:

* normal keys (at most ``max_group_rows`` rows) take the one-shuffle path:
  rows are hash-partitioned by key once and every window/aggregate reuses that
  partitioning;
* hot keys are spread over many tasks: exact per-key positions come from a
  range partitioning on ``(key, order)`` plus per-partition offsets, and
  windows then run over bounded blocks ``(key, block)``.

The set of hot keys is bounded by ``rows / max_group_rows``; it is counted
before it is broadcast, with a shuffle join beyond the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsense.session import materialize

#: rows per key above which a key is treated as hot. A bounded trip is held in one task by the
#: exact percentile and Hilbert buffers (~12 channels x 8-40 bytes per row: ~120 MB at this size);
#: real trips are far shorter (hours of 1 Hz samples), larger keys take the distributed hot path.
DEFAULT_MAX_GROUP_ROWS = 250_000
#: largest per-key table that is broadcast (bytes); beyond it a shuffle join is used
MAX_BROADCAST_BYTES = 32 << 20
#: rows of a block of a hot trip, if the caller names none
DEFAULT_BLOCK_ROWS = 65_536
#: bits of ``monotonically_increasing_id`` that hold the row position in a partition
_MONO_POS_BITS = 33


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _row_bytes(df: DataFrame) -> tuple[int, list[Column]]:
    """Bytes of a row without its variable parts, and the sizes of those (strings, binaries, arrays of numbers)."""
    fixed, variable = 16, []
    for name, kind in df.dtypes:
        fixed += 16
        if kind in ("string", "binary"):
            variable.append(F.octet_length(f"`{name}`"))
        elif kind.startswith("array<") and "<" not in kind[6:] and "string" not in kind:
            variable.append(F.size(f"`{name}`") * 16)
        elif kind.startswith(("array", "map", "struct")):
            variable.append(F.octet_length(F.to_json(f"`{name}`")) * 2)
    return fixed, variable


def fits_broadcast(small: DataFrame, rows: int | None = None, limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``small`` has at most ``limit`` bytes, variable parts as they are. Reads a row past the limit at
    most; ``rows``: their number if it is known."""
    fixed, variable = _row_bytes(small)
    most = limit // fixed
    if rows is not None and (rows > most or not variable):
        return rows <= most
    sizes = [F.coalesce(F.sum(F.greatest(v, F.lit(0)).cast("long")), F.lit(0)) for v in variable]
    n, *more = small.limit(most + 1).agg(F.count(F.lit(1)), *sizes).first()
    return n <= most and n * fixed + sum(more) <= limit


def join_small(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner",
               small_rows: int | None = None) -> DataFrame:
    """Join a per-key table onto a large frame, broadcasting it only under a checked size in bytes
    (``small_rows``: the row count of ``small``, where it is known); beyond that both sides are shuffled."""
    return big.join(F.broadcast(small) if fits_broadcast(small, small_rows) else small, on=_cols(on), how=how)


def split_hot_keys(df: DataFrame, key: str | Sequence[str], max_group_rows: int = DEFAULT_MAX_GROUP_ROWS
                   ) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Split ``df`` into (normal rows, hot rows, hot-key table).

    The key counts are a partial aggregate (no row shuffle). When no key is hot,
    which is the usual case, the input is returned untouched so its plan keeps
    a single exchange.
    """
    keys = _cols(key)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialize(counts.filter(F.col("_rows") > F.lit(max_group_rows)))
    n_hot = hot.count()
    if n_hot == 0:
        return df, None, None
    normal = join_small(df, hot.select(*keys), keys, "left_anti", n_hot)
    hot_rows = join_small(df, hot.select(*keys), keys, "left_semi", n_hot)
    return normal, hot_rows, hot


def ranked_positions(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str],
                     partitions: int | None = None) -> DataFrame:
    """Exact 0-based position ``_i`` of every row within its key, and the key size ``_n``.

    Works for keys of any size without putting a key in one task:

    1. range-partition on ``(key, order)`` and sort inside partitions, so a big
       key spans many partitions and every partition is bounded;
    2. ``monotonically_increasing_id`` then numbers rows in that order inside
       each partition; the frame is checkpointed so the numbers are fixed;
    3. a per-(partition, key) table (one row per pair, bounded by partitions +
       keys) gives each key's offset in earlier partitions;
    4. position = offset + (id - first id of the key in the partition).

    ``order`` must be a total order within a key for the result to be unique.
    """
    keys = _cols(key)
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df.repartitionByRange(partitions, *[F.col(k) for k in keys], *order_cols)
              .sortWithinPartitions(*keys, *order_cols)
              .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = materialize(ranged)
    ranged = ranged.withColumn("_pid", F.shiftright("_mono", _MONO_POS_BITS))
    seg = (ranged.groupBy("_pid", *keys)
           .agg(F.min("_mono").alias("_m0"), F.count(F.lit(1)).alias("_c")))
    w_before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = (seg.withColumn("_off", F.coalesce(F.sum("_c").over(w_before), F.lit(0)))
           .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))))
    seg = seg.select("_pid", *keys, "_m0", "_off", "_n")
    out = join_small(ranged, seg, ["_pid", *keys])
    return (out.withColumn("_i", (F.col("_off") + F.col("_mono") - F.col("_m0")).cast("long"))
            .drop("_pid", "_m0", "_off", "_mono"))


def block_with_halo(df: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Assign ``_blk = _i div block_rows`` and copy the last ``halo`` rows of each block
    into the next block (flag ``_halo``), so trailing row windows of up to
    ``halo + 1`` rows are exact inside every ``(key, _blk)`` partition. A block holds at
    least ``halo + 1`` rows, so the halo always lies in the one block before it.
    """
    if block_rows < 1:
        raise ValueError("block_rows must be positive")
    block_rows = max(block_rows, halo + 1)
    base = df.withColumn("_blk", F.floor(F.col("_i") / block_rows).cast("long")).withColumn("_halo", F.lit(False))
    if halo <= 0:
        return base
    tail = (base.filter(((F.col("_i") % block_rows) >= block_rows - halo)
                        & (F.col("_blk") < F.floor((F.col("_n") - 1) / block_rows)))
            .withColumn("_blk", F.col("_blk") + 1).withColumn("_halo", F.lit(True)))
    return base.unionByName(tail)


def prefix_sums(df: DataFrame, key: str | Sequence[str] | None, order: Sequence[Column | str],
                values: Sequence[str], partitions: int | None = None, totals: bool = False) -> DataFrame:
    """Inclusive running sums ``_cum_<v>`` of ``values`` along ``order`` within each key, and its totals ``_all_<v>`` if ``totals``.

    Distributed like :func:`ranked_positions`: range partitioning on
    ``(key, order)`` bounds every task, running sums inside each range
    partition, plus the totals of the key in earlier partitions (a table with
    one row per (partition, key) pair, broadcast under a size check). With
    ``key=None`` the sums run over the whole frame (e.g. an ROC curve).
    """
    keys = _cols(key) if key else []
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df.repartitionByRange(partitions, *[F.col(k) for k in keys], *order_cols)
              .sortWithinPartitions(*keys, *order_cols)
              .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = materialize(ranged).withColumn("_pid", F.shiftright("_mono", _MONO_POS_BITS))
    local = Window.partitionBy("_pid", *keys).orderBy("_mono").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({f"_loc_{v}": F.sum(v).over(local) for v in values})
    tot = ranged.groupBy("_pid", *keys).agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"_tot_{v}").over(Window.partitionBy(*keys)).alias(f"_all_{v}") for v in values] if totals else []
    tot = tot.select("_pid", *keys, *[F.coalesce(F.sum(f"_tot_{v}").over(before), F.lit(0)).alias(f"_off_{v}")
                                      for v in values], *whole)
    out = join_small(ranged, tot, ["_pid", *keys])
    return (out.withColumns({f"_cum_{v}": F.col(f"_off_{v}") + F.col(f"_loc_{v}") for v in values})
            .drop("_pid", "_mono", *[f"_loc_{v}" for v in values], *[f"_off_{v}" for v in values]))


def global_rank(df: DataFrame, order: Sequence[Column | str], key: str | Sequence[str] | None = None) -> DataFrame:
    """Exact 0-based rank ``_rank`` along ``order`` (within ``key`` if given) and group size ``_size``.

    A distributed ``row_number``: no single task sees the whole frame.
    """
    ones = df.withColumn("_one", F.lit(1))
    ranked = prefix_sums(ones, key, order, ["_one"])
    keys = _cols(key) if key else []
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")) if keys else None
    ranked = ranked.withColumn("_rank", F.col("_cum__one") - 1).drop("_one", "_cum__one")
    if sizes is None:
        n = ranked.count()
        return ranked.withColumn("_size", F.lit(n))
    return join_small(ranked, sizes, keys)
