import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripsense.llm import cross_polytope as cp
from tripsense.llm import whitening as wh

ROWS = "vec_id bigint, embedding array<float>, label int"


def frame(spark, vectors, ids=None, schema=ROWS):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0)
                                  for i, v in zip(ids, vectors)], schema)


BAD = [None, [], [1.0, None, 2.0, 0.5], [math.nan] * 4, [math.inf, 0.0, 0.0, 1.0], [1.0, 2.0]]


# ------------------------------------------------------------------------------------------ whitening
def whitened(x):
    """Components, deviations and whitened rows by the covariance's eigenvectors."""
    c = x - x.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / len(x))
    e, q = e[::-1], q[:, ::-1]
    keep = e > 1e-12 * e[0]
    return c @ q[:, keep] / np.sqrt(e[keep]), e[keep], e.sum()


def check_whitening(rows, ids, x, components=32):
    n, d = x.shape
    sums = [int(s) for s in x.sum(axis=0)]
    want, e, trace = whitened(x.astype(float) - 1_000_000)
    k = min(components, len(e))
    assert len(rows) == n * k
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    y = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((y * want[:, :k]).sum(axis=0))
    assert np.abs(y * sign - want[:, :k]).max() < 1e-6
    for i, row in zip(ids, x):
        assert {r.deviation for r in got[i].values()} == {sum((n * int(a) - s) ** 2 for a, s in zip(row, sums))}
        assert {r.n for r in got[i].values()} == {n}
        assert np.allclose([got[i][c].explained for c in range(1, k + 1)], e[:k] / trace, rtol=1e-6)
    assert rows[0].identity_error < 1e-6
    assert np.abs(np.cov(y.T, bias=True) - np.eye(k)).max() < 1e-6


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((200, 7)) * [3, 2, 1, 1, 0.5, 0.1, 0.05] @ rng.standard_normal((7, 7)) + 5).astype(np.float32)
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    got = wh.op12(frame(spark, v).withColumn("n", F.lit("clash")).withColumn("ids", F.lit("clash")).repartition(5)).collect()
    check_whitening(got, range(200), x)


def test_whitening_more_dimensions_than_components(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 40)).astype(np.float32)
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    check_whitening(wh.op12(frame(spark, v)).collect(), range(300), x)


def test_whitening_rank_deficient_repeated_and_few_rows(spark):
    rng = np.random.default_rng(5)
    few = rng.integers(-50, 50, (4, 9)) / 64.0  # fewer rows than dimensions: three directions
    x = np.floor(64 * few).astype(np.int64) + 1_000_000
    check_whitening(wh.op12(frame(spark, few)).collect(), range(4), x)
    flat = np.repeat(rng.integers(-50, 50, (30, 2)) / 64.0, 3, axis=1)  # equal and constant dimensions
    flat[:, 5] = 2.0
    x = np.floor(64 * flat).astype(np.int64) + 1_000_000
    check_whitening(wh.op12(frame(spark, flat)).collect(), range(30), x)
    doubled = wh.op12(frame(spark, np.concatenate([few, few]), [0, 1, 2, 3] * 2))
    assert doubled.count() == 8 * 3 and doubled.distinct().count() == 4 * 3


def test_whitening_drops_bad_rows_and_empty_results(spark):
    rng = np.random.default_rng(6)
    good = [list(map(float, r)) for r in rng.integers(-99, 99, (12, 4))]
    got = wh.op12(frame(spark, BAD + good, [*range(100, 100 + len(BAD)), *range(12)])).collect()
    check_whitening(got, range(12), (64 * np.array(good)).astype(np.int64) + 1_000_000)
    assert wh.op12(frame(spark, [])).count() == 0
    assert wh.op12(frame(spark, [None, None])).count() == 0
    assert wh.op12(frame(spark, [[1.0, 2.0]])).count() == 0  # no variance, no component
    assert wh.op12(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    named = wh.op12(frame(spark, good, [None, *range(1, 12)]))
    assert named.filter("vec_id IS NULL").count() == 4


def test_exact_integers():
    assert wh.squared_length(np.array([[3, 4]]))[0] == 25
    assert wh.squared_length(np.array([[2**31, 2**30], [1, 0]])).tolist() == [2**62 + 2**60, 1]
    with pytest.raises(OverflowError):
        wh.squared_length(np.array([[2**32, 2**32]]))
    with pytest.raises(OverflowError):
        wh.integers(np.array([[1e30]]), 64)
    n, sums = 10**13, [10**19 + 7, -3]  # beyond int64
    got = wh.exact_differences(np.array([[10**6, 5]]), n, sums)
    assert [int(g) for g in got[0]] == [10**19 - sums[0], 5 * 10**13 + 3]


def test_bidiagonalisation_keeps_the_bases_orthogonal():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 30)) * np.logspace(0, -5, 30)

    def product(w, a):
        u = x @ w
        return [x.T @ u, float(u @ u), (x @ a).T @ u]

    v, b = wh.bidiagonalise(product, 30, 30, 30)
    assert np.abs(v.T @ v - np.eye(30)).max() < 1e-12
    assert np.allclose(np.tril(b, -1), 0) and np.allclose(np.triu(b, 2), 0)
    assert np.allclose(np.linalg.svd(b, compute_uv=False), np.linalg.svd(x, compute_uv=False), rtol=1e-8, atol=1e-13)
    small, _ = wh.bidiagonalise(product, 30, 30, 3)
    assert small.shape[1] < 30  # a falling spectrum converges early


# ----------------------------------------------------------------------------------------- neighbours
def brute(vectors, ids, k=5, every=50):
    x = cp.scaled(np.asarray(vectors, dtype=np.float64))
    out = {}
    for at, i in enumerate(ids):
        if i % every == 0:
            score = cp.cosines(np.repeat(x[at:at + 1], len(x), axis=0), x)
            best = sorted((-s, j) for s, j in zip(score, ids) if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_hadamard_is_orthonormal_and_hashing_is_nearest_axis():
    x = np.random.default_rng(0).standard_normal((20, 16))
    assert np.allclose(np.linalg.norm(cp.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cp.hadamard(cp.hadamard(x)), x)
    signs = cp.rotation_signs(13, 1, 2, 1)
    assert signs.shape == (1, 2, 3, 16)
    unit = x[:, :13] / np.linalg.norm(x[:, :13], axis=1)[:, None]
    y = cp.rotated(unit, signs[0, 0])
    score = cp.axis_scores(unit, signs[0, 0])
    axis = score.argmax(axis=1)
    assert (np.abs(y).max(axis=1) == score.max(axis=1)).all()
    assert (cp.bucket_of(unit, signs[0]) == axis * 32 + cp.axis_scores(unit, signs[0, 1]).argmax(axis=1)).all()
    probes = cp.probes_of(unit, signs[0], 32 * 32)
    assert (probes[:, 0] == cp.bucket_of(unit, signs[0])).all()
    assert (np.sort(probes, axis=1) == np.arange(1024)).all()
    total = np.array([((score[r].max() - score[r]) ** 2)[probes[r] // 32]
                      + ((lambda s: (s.max() - s) ** 2)(cp.axis_scores(unit, signs[0, 1])[r]))[probes[r] % 32] for r in range(20)])
    assert (np.diff(total, axis=1) >= 0).all()
    assert (cp.probes_of(unit, signs[0], 10) == probes[:, :10]).all()


@pytest.mark.parametrize("hashes,probes", [(1, 32), (2, 400)])
def test_recall_against_brute_force(spark, hashes, probes):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    v = (np.repeat(centres, 50, axis=0) + 0.6 * rng.standard_normal((2000, 24))).astype(np.float32)
    want = brute(v, range(2000))
    got = as_dict(cp.neighbours(frame(spark, v).repartition(6), hashes=hashes, probes=probes))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    exact = {(q, j): s for q in want for j, s in brute(v, range(2000), k=1999, every=50)[q][:200]}
    for q in got:
        assert [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
        assert all(exact.get((q, i), s) == s for i, s in got[q])


def test_hot_vectors_ties_and_cells(spark, monkeypatch):
    monkeypatch.setattr(cp, "CELL_ROWS", (8, 16))
    rng = np.random.default_rng(9)
    v = rng.standard_normal((600, 8)).astype(np.float32)
    v[100:300] = v[100]  # a third are copies: only the smallest ids may come back
    v[300:400] = v[0] + 0.001 * v[300:400]  # near copies fill one bucket
    got = as_dict(cp.neighbours(frame(spark, v), probes=16, tables=6))
    want = brute(v, range(600))
    for q in (100, 150, 200, 250, 300, 350):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == [s for _, s in want[q]]
    assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104] and [i for i, _ in got[100]] == [101, 102, 103, 104, 105]


def test_few_bad_and_repeated_rows(spark):
    good = [[1.0, 0, 0, 0], [1, 0.125, 0, 0], [0, 1, 0, 0], [0, 0, -1, 0]]
    rows = frame(spark, good + BAD + [[0.0] * 4, [5.0, 0, 0, 0]], [0, 1, 2, 3, *range(50, 50 + len(BAD)), 100, None])
    clash = rows.withColumn("id", F.lit("x")).withColumn("vec", F.lit("x")).withColumn("bucket", F.lit("x"))
    want = brute(good, range(4))
    assert as_dict(cp.op13(clash)) == want and [i for i, _ in want[0]] == [1, 2, 3]
    assert as_dict(cp.op13(rows.unionByName(rows).unionByName(rows))) == want  # repeated rows count once
    two = rows.unionByName(frame(spark, [[0, 0.0, 0, 1], [-1, 0, 0, 0.0]], [1, 1]))  # more vectors under one id
    assert [i for i, _ in as_dict(cp.op13(two))[0]] == [1, 2, 3]
    assert cp.op13(frame(spark, [])).count() == 0
    assert cp.op13(frame(spark, [[1.0, 2.0]])).count() == 0
    huge = frame(spark, [[1e300, 0.0], [1e300, 1e300], [0.0, 1e-300]], schema="vec_id long, embedding array<double>, label int")
    assert [(i, round(s, 12)) for i, s in as_dict(cp.op13(huge))[0]] == [(1, round(0.5 ** 0.5, 12)), (2, 0.0)]
