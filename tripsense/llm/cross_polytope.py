"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector with ``hashes`` pseudo-random rotations (three rounds of random
signs and a fast Hadamard transform each, on the dimension padded to a power of two): a hash is
the nearest signed axis, and a bucket the axes of all hashes. Every row enters one bucket of each
table. A query probes in each table the buckets whose axes lie nearest to it (for several
hashes by the sum of squared shortfalls against the best axis), and the rows found there are its
candidates. They are reranked by the cosine of the original vectors in double precision.

Buckets are cells of the shuffle that carries the vectors, so a candidate is compared where it
lies and only the best of a cell leave it. Cell sizes are counted first: a bucket with many
rows or many probing queries is dealt over a grid of cells, each with a bounded share of both, so no task
holds a hot bucket whole. More than ``k + 1`` copies of one vector tie with each other: those with larger ids
can't be among the ``k`` nearest of any query and don't enter the tables. Queries that find fewer than ``k``
neighbours search all rows of one table, so what is returned is short only if the rows are.

The defaults (4 tables, 32 of the ``2 x 64`` buckets of each) are for vectors whose nearest neighbours are
far: on the given tables, where the fifth neighbour has a cosine of about 0.45, they find 0.98 of the
true neighbours. Where neighbours are close, fewer probes and more hashes do.

Defined results: rows with a NULL id, a NULL or zero vector or NULL or non-finite entries take no part, nor do vectors
of another length than the most frequent one; repeated rows count once, and several vectors under one id are one
candidate with its best likeness; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsense.llm.common import shuffle_partitions
from tripsense.llm.vectors import finite_vectors, list_column, matrix
from tripsense.operators.keyed import join_small
from tripsense.session import materialize

#: fewest and most rows (or queries) of a bucket that share a cell; the most bounds a task's memory
CELL_ROWS = (256, 16_384)
_QUERY_BLOCK = 256
_SLACK = 1e-9  # the matrix product may order what differs by less; such candidates are compared exactly


# ------------------------------------------------------------------------------------------ hashing
def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row (orthonormal; the width is a power of two)."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotation_signs(d: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Random signs ``(table, hash, round, width)`` of all rotations."""
    width = 1 << max(0, d - 1).bit_length()
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, width))


def rotated(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """One pseudo-random rotation of unit vectors (padded with zeros to the width of ``signs``)."""
    y = np.zeros((len(unit), signs.shape[1]))
    y[:, :unit.shape[1]] = unit
    for s in signs:
        y = hadamard(y * s)
    return y


def axis_scores(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Inner products with all signed axes: positive ones first, then negative ones."""
    y = rotated(unit, signs)
    return np.concatenate([y, -y], axis=1)


def bucket_of(unit: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The bucket of each vector in one table."""
    bucket = np.zeros(len(unit), dtype=np.int64)
    for signs in table:
        bucket = bucket * (2 * signs.shape[1]) + axis_scores(unit, signs).argmax(axis=1)
    return bucket


def probes_of(unit: np.ndarray, table: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` best buckets of each vector in one table, best first."""
    buckets, cost = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
    for signs in table:
        score = axis_scores(unit, signs)
        short = (score.max(axis=1, keepdims=True) - score) ** 2
        total = (cost[:, :, None] + short[:, None, :]).reshape(len(unit), -1)
        code = (buckets[:, :, None] * score.shape[1] + np.arange(score.shape[1])).reshape(len(unit), -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :probes]  # the best sums need the best parts only
        buckets, cost = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1)
    return buckets


# ---------------------------------------------------------------------------------------- exact part
def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest entry near 1: cosines stay the same, no overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows; equal pairs give equal values wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """``(query id, row id, cosine)`` of the ``k`` nearest other rows of each query, by a blocked matrix product
    whose best are compared exactly."""
    queries, rows = scaled(queries), scaled(rows)
    unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    most = k + len(ids) - len(np.unique(ids))  # several vectors under one id must not crowd others out
    out = []
    for at in range(0, len(queries), _QUERY_BLOCK):
        q, q_ids = queries[at:at + _QUERY_BLOCK], query_ids[at:at + _QUERY_BLOCK]
        score = (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ unit.T
        score[q_ids[:, None] == ids[None, :]] = -np.inf
        if len(ids) > most:
            least = -np.partition(-score, most - 1, axis=1)[:, most - 1:most]
        else:
            least = np.full((len(q), 1), -2.0)
        r, c = np.nonzero((score >= least - _SLACK) & (score > -np.inf))
        exact = cosines(q[r], rows[c])
        order = np.lexsort((ids[c], -exact, r))
        order = order[np.sort(np.unique(np.column_stack([r, ids[c]])[order], axis=0, return_index=True)[1])]
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        keep = place < k
        out.append((q_ids[r[keep]], ids[c[keep]], exact[keep]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.array([], dtype=np.int64)] * 2 + [np.array([])]


# ------------------------------------------------------------------------------------------ operator
def _without_spare_copies(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` without the copies of a vector that have ``k + 1`` copies with smaller ids. Only vectors whose
    64-bit hash occurs that often are compared; of those a task sends ``k + 1`` rows of a vector at most."""
    often = materialize(rows.groupBy(F.xxhash64("vec").alias("h")).agg(F.count(F.lit(1)).alias("c"))
                        .filter(F.col("c") > k + 1).select("h"))
    if often.isEmpty():
        return rows
    keyed = rows.withColumn("h", F.xxhash64("vec"))
    first = Window.partitionBy("vec").orderBy("id")
    kept = (join_small(keyed, often, "h", "left_semi").select("id", "vec").distinct()
            .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1))
    return join_small(keyed, often, "h", "left_anti").select("id", "vec").unionByName(kept.select("id", "vec"))


def _hashed(rows: DataFrame, d: int, codes, vectors: bool) -> DataFrame:
    """``bucket, id[, vec]``: a row for each bucket that ``codes(unit)`` (a matrix) names for a vector."""
    kind = rows.schema["vec"].dataType.simpleString()
    floats = np.float32 if kind == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), d)
            near = scaled(x)
            code = codes(near / np.sqrt((near * near).sum(axis=1))[:, None])
            columns = [pa.array(code.ravel()), pa.array(np.repeat(np.asarray(batch.column("id")), code.shape[1]))]
            if vectors:
                columns.append(list_column(np.repeat(x.astype(floats), code.shape[1], axis=0)))
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "id", "vec"][:len(columns)])

    return rows.mapInArrow(run, f"bucket long, id long, vec {kind if kind == 'array<float>' else 'array<double>'}" if vectors
                           else "bucket long, id long")


def _search(rows: DataFrame, queries: DataFrame, d: int, signs: np.ndarray, probes: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` best candidates of each query at most."""
    tables, hashes, _, width = signs.shape
    per_table = (2 * width) ** hashes

    def entries(unit):
        return np.stack([bucket_of(unit, signs[t]) + t * per_table for t in range(tables)], axis=1)

    def probed(unit):
        return np.concatenate([probes_of(unit, signs[t], probes) + t * per_table for t in range(tables)], axis=1)

    count = lambda df, name: df.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    sizes = materialize(count(_hashed(rows, d, entries, False), "n_rows")
                        .join(count(_hashed(queries, d, probed, False), "n_queries"), "bucket"))
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    share = min(max(total // (2 * shuffle_partitions(rows)), CELL_ROWS[0]), CELL_ROWS[1])
    grid = sizes.select("bucket", F.ceil(F.col("n_rows") / share).cast("int").alias("across"),
                        F.ceil(F.col("n_queries") / share).cast("int").alias("down"))
    deal = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (join_small(_hashed(queries, d, probed, True), grid, "bucket")
            .select("bucket", every("across").alias("col"), deal("down").alias("row"), "id", "vec"))
    right = (join_small(_hashed(rows, d, entries, True), grid, "bucket")
             .select("bucket", deal("across").alias("col"), every("down").alias("row"), "id", "vec"))
    cell = ["bucket", "col", "row"]

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            found = [np.array([], dtype=np.int64)] * 2 + [np.array([])]
        else:
            ids, x = np.asarray(held["id"]), matrix(held["vec"], d)
            _, once = np.unique(np.column_stack([ids.view(np.float64), x]), axis=0, return_index=True)  # repeated rows
            found = nearest(np.asarray(asked["id"]), matrix(asked["vec"], d), ids[once], x[once], k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})

    pairs = (left.groupBy(*cell).cogroup(right.groupBy(*cell))
             .applyInArrow(compare, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))


def neighbours(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 50, k: int = 5,
               tables: int = 4, hashes: int = 1, probes: int = 32, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id ``query_every`` divides."""
    rows, d = finite_vectors(rows, id_col, vec_col)
    rows = rows.filter(F.col("id").isNotNull() & F.exists("vec", lambda v: v != 0))
    queries = rows.filter(F.col("id") % query_every == 0)
    held = _without_spare_copies(rows, k)
    signs = rotation_signs(d, tables, hashes, seed)
    found = materialize(_search(held, queries, d, signs, probes, k))
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = materialize(queries.join(full, "id", "left_anti"))
    if not short.isEmpty():  # all buckets of one table hold every row
        rest = _search(held, short, d, signs[:1], (2 * signs.shape[3]) ** hashes, k)
        found = join_small(found, short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13(embeddings: DataFrame) -> DataFrame:
    return neighbours(embeddings)
