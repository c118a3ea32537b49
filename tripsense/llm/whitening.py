"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become integers ``x = floor(scale * c) + shift``; counts, sums and deviations are exact
integers. With ``X`` the centred rows, alternating distributed products build orthonormal ``V``
(one entry a dimension) and ``U`` (one entry a row) with ``X V = U B``, ``B`` upper bidiagonal: a
step multiplies the rows by a vector (``u = X w``) and the result back (``X^T u``), in one
job over packed blocks. Both bases are reorthogonalised in full. The right vectors live on
the driver. The left ones are as long as the table and are never stored or moved: a block derives its
entries of all earlier ones as ``X A`` from the small matrix ``A`` of their coefficients (``u_j = X a_j``), so every
job is a function of the input rows and a few small matrices, and a lost executor costs only a rerun of its tasks.

The SVD of the small ``B`` gives components (``V`` times its right vectors) and deviations (singular values, by
``e = s^2 / n``). The steps end when the leading components have converged to rounding, at the latest when
``V`` spans the whole space; a step that finds an exhausted subspace goes on with a new orthogonal direction.

Defined results: rows whose vector is NULL, empty or of another length than the most frequent one, or holds NULL or
non-finite entries are dropped; a NULL id stays NULL; repeated rows count as often as they occur; directions without variance (singular
value at most 1e-10 of the largest) are no components, so equal rows or a single one give an empty result, as does an
empty table; an entry whose integer exceeds a long is an error, and a deviation that exceeds one too; other
columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.llm.vectors import finite_vectors, matrix

_NO_VARIANCE = 1e-10  # of the largest singular value
_CONVERGED = 1e-15  # residual of a component, of the largest singular value
_LONG = 2**62


def integers(c: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(scale * c)
    if len(x) and np.abs(x).max() >= _LONG:
        raise OverflowError("an entry of an embedding times the scale exceeds a long")
    return x.astype(np.int64)


def packed_blocks(rows: DataFrame, d: int, scale: int) -> DataFrame:
    """``ids array<long>, x binary, kind string``: the integers of an Arrow batch (before the shift) in the smallest
    type that holds them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = integers(matrix(batch.column("vec"), d), scale)
                kind = np.result_type(np.min_scalar_type(min(int(x.min()), -1)), np.min_scalar_type(-1 - int(x.max().clip(0))))
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.astype(kind).tobytes()]), pa.array([kind.str])], ["ids", "x", "kind"])

    return rows.mapInArrow(pack, "ids array<long>, x binary, kind string")


def unpacked(batch: pa.RecordBatch, d: int, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of each block."""
    for k in range(batch.num_rows):
        x = np.frombuffer(batch.column("x")[k].as_py(), np.dtype(batch.column("kind")[k].as_py()))
        yield batch.column("ids")[k].values, x.reshape(-1, d).astype(np.int64) + shift


def exact_differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, as int64 where that is wide enough, else as Python integers."""
    wide = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums)) >= _LONG
    return (x.astype(object) if wide else x) * n - np.array(sums, dtype=object if wide else np.int64)


def squared_length(diff: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each row; an error beyond a long."""
    top = int(np.abs(diff).max(initial=0))
    if top * top * max(1, diff.shape[1]) < 2**63:
        return (diff.astype(np.int64) ** 2).sum(axis=1)
    out = (diff.astype(object) ** 2).sum(axis=1)
    if max(out) >= 2**63:
        raise OverflowError("a deviation exceeds a long")
    return out.astype(np.int64)


def added_up(blocks: DataFrame, part: Callable[[pa.RecordBatch], Iterator[list]]) -> list:
    """The sums, element by element, of the lists of arrays or integers that ``part`` gives for each block. Every
    task returns one sum; many are added by some tasks before they come to the driver."""
    def add(items):
        total = None
        for item in items:
            total = item if total is None else [a + b for a, b in zip(total, item)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)])], ["sums"])

    def first(batches):
        return add(item for batch in batches for item in part(batch))

    def again(batches):
        return add(pickle.loads(x.as_py()) for batch in batches for x in batch.column("sums"))

    sums, parts = blocks.mapInArrow(first, "sums binary"), blocks.rdd.getNumPartitions()
    if parts > 256:
        sums = sums.repartition(math.isqrt(parts)).mapInArrow(again, "sums binary")
    total = None
    for row in sums.toLocalIterator() if parts > 4096 else sums.collect():
        item = pickle.loads(row.sums)
        total = item if total is None else [a + b for a, b in zip(total, item)]
    return total


def bidiagonalise(product: Callable, d: int, steps: int, wanted: int, seed: int = 1):
    """``V`` (columns) and the upper bidiagonal ``B``. ``product(w, A)`` gives ``X^T u``, ``u.u`` and ``(X A)^T u`` for ``u = X w``."""
    rng = np.random.default_rng(seed)

    def fresh(basis: np.ndarray) -> np.ndarray:
        z = rng.standard_normal(d)
        for _ in range(3):
            z -= basis @ (basis.T @ z)
            z /= np.linalg.norm(z)
        return z

    v, a, p = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # right vectors; u_j = X a_j; p_j = X^T u_j
    alphas, betas, largest, nxt = [], [], 0.0, fresh(np.zeros((d, 0)))
    while True:
        w = nxt - (a[:, -1] * betas[-1] if betas else 0.0)
        w -= a @ (p.T @ w)  # against all earlier left vectors: U^T X w = P^T w
        back, square, mixed = product(w, a)
        w, back, square = w - a @ mixed, back - p @ mixed, square - mixed @ mixed  # and once more, as measured
        v = np.column_stack([v, nxt])
        alpha = math.sqrt(max(square, 0.0))
        largest = max(largest, alpha, *betas) if betas else max(largest, alpha)
        if alpha <= 1e-13 * largest or alpha == 0.0:
            alpha, left, back = 0.0, np.zeros(d), np.zeros(d)  # X leads no further from here
        else:
            left, back = w / alpha, back / alpha
        alphas.append(alpha)
        a, p = np.column_stack([a, left]), np.column_stack([p, back])
        k = len(alphas)
        if k == steps:
            break
        z = back - alpha * nxt
        for _ in range(2):
            z -= v @ (v.T @ z)
        beta = float(np.linalg.norm(z))
        if beta <= 1e-13 * largest or beta == 0.0:
            beta, z = 0.0, fresh(v)
        else:
            z /= beta
            if k >= wanted:
                left_small, s, _ = np.linalg.svd(_bidiagonal(alphas, betas))
                if beta * np.abs(left_small[-1, :wanted]).max() <= _CONVERGED * s[0]:
                    break
        betas.append(beta)
        nxt = z
    return v, _bidiagonal(alphas, betas)


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000,
           components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per remaining row and component."""
    spark = embeddings.sparkSession
    schema = (f"{id_col} long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    rows, d = finite_vectors(embeddings, id_col, vec_col)
    if d == 0:
        return spark.createDataFrame([], schema)
    blocks = packed_blocks(rows, d, scale).persist(StorageLevel.MEMORY_AND_DISK)

    def moments(batch):
        for _, x in unpacked(batch, d, shift):
            wide = int(np.abs(x).max()) * len(x) >= _LONG
            yield [len(x), (x.astype(object) if wide else x).sum(axis=0).astype(object)]

    n, sums = added_up(blocks, moments)
    sums = [int(s) for s in sums]

    def centred(x):
        return exact_differences(x, n, sums).astype(np.float64) / n

    def spread(batch):
        for _, x in unpacked(batch, d, shift):
            yield [(centred(x) ** 2).sum()]

    (total,) = added_up(blocks, spread)
    if total == 0.0:
        return spark.createDataFrame([], schema)

    def product(w, a):
        def part(batch):
            for _, x in unpacked(batch, d, shift):
                c = centred(x)
                u = c @ w
                yield [c.T @ u, float(u @ u), (c @ a).T @ u]
        return added_up(blocks, part)

    v, b = bidiagonalise(product, d, min(d, n), components)
    _, s, right = np.linalg.svd(b)
    s = s[:components]
    s = s[s > _NO_VARIANCE * s[0]]
    axes = v @ right[:len(s)].T
    deviations = s / math.sqrt(n)
    turn = axes / deviations
    explained = s * s / total

    def covariance(batch):
        for _, x in unpacked(batch, d, shift):
            y = centred(x) @ turn
            yield [y.sum(axis=0), y.T @ y]

    mean, scatter = added_up(blocks, covariance)
    mean = mean / n
    error = float(np.abs(scatter / n - np.outer(mean, mean) - np.eye(len(s))).max())

    def output(batches):
        m, numbers = len(s), np.arange(1, len(s) + 1, dtype=np.int32)
        for batch in batches:
            for ids, x in unpacked(batch, d, shift):
                for at in range(0, len(x), 1024):
                    some = x[at:at + 1024]
                    k = len(some)
                    diff = exact_differences(some, n, sums)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.repeat(np.arange(at, at + k), m))), pa.array(np.tile(numbers, k)),
                         pa.array(np.full(k * m, n, dtype=np.int64)), pa.array(np.repeat(squared_length(diff), m)),
                         pa.array((diff.astype(np.float64) / n @ turn).ravel()), pa.array(np.tile(explained, k)),
                         pa.array(np.full(k * m, error))],
                        [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(output, schema)


def op12(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
