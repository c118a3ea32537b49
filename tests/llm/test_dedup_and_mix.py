import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tripsense.llm import exact_dedup, jaccard_join, mixing, substring_dedup
from tripsense.llm.components import components

from .helpers import EDGE, documents, near_copies, words


# ------------------------------------------------------------------------------------------- exact dedup
def brute_exact(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for k, t in enumerate(norm):
        groups[t].append(k)
    return {k: (groups[t][0], len(groups[t]), k == groups[t][0], hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(norm)}


@pytest.mark.parametrize("extra", [False, True])
def test_exact_matches_brute_force(spark, extra):
    texts = EDGE + ["same text"] * 40 + ["same\ttext", "same  text", "Same text"]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.op5(documents(spark, texts, extra)).collect()}
    assert got == brute_exact(texts)


def test_exact_compares_bytes_when_hashes_collide(spark):
    texts = ["a", "b", "c", "a", "b", "a ", None, ""]
    weak = lambda c: F.lit("0")
    got = {r["doc_id"]: (r["_xd_keep_id"], r["_xd_group_size"], r["_xd_kept"], r["_xd_sha256"])
           for r in exact_dedup.exact_dedup(documents(spark, texts), hash_fn=weak).collect()}
    assert got == brute_exact(texts)


def test_exact_keeps_columns_null_ids_and_repeats(spark):
    docs = documents(spark, ["t", "t", "t", "u", "u"], extra=True, ids=[None, 3, 3, None, None])
    out = exact_dedup.exact_dedup(docs)
    assert [c for c in out.columns if not c.startswith("_xd_")] == docs.columns
    got = sorted((str(r["doc_id"]), str(r["_xd_keep_id"]), r["_xd_group_size"], r["_xd_kept"]) for r in out.collect())
    assert got == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert exact_dedup.op5(docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------- mixing
def brute_mix(rows, weights=(3, 1, 2), share=1.5):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, target, open_ = share * sum(size.values()), {}, set(order)
    while open_:                                          # reshare the excess until no source is above its ceiling
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    return size, target


def test_mix_reaches_its_targets(spark):
    texts = [("w " * (1 + k % 7)).strip() for k in range(400)] + [None, "", "  "]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(
        F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    size, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    taken = Counter()
    for r in got:
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 14, s
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_edge_cases(spark):
    assert mixing.op3(documents(spark, []).limit(0)).count() == 0
    only_empty = mixing.op3(documents(spark, [None, "", " "], extra=True)).collect()
    assert [(r["size"], r["taken"]) for r in only_empty] == [(0, 0)] * 3
    twice = mixing.op3(documents(spark, ["a b c"] * 2 + ["d"], ids=[1, 1, 2]).withColumn("source", F.lit("s"))).collect()
    assert len(twice) == 3 and all(r["taken"] <= 2 * r["size"] for r in twice)


# ------------------------------------------------------------------------------------------- Jaccard join
def brute_sets(texts):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for t in texts:
        w = (t or "").encode().translate(low).split()
        out.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts):
    sets, root = brute_sets(texts), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize("seed,frequent,sketch", [(1, 32, 4), (2, 2, 1), (3, 3, 1)])
def test_jaccard_components(spark, seed, frequent, sketch):
    texts = EDGE + near_copies(seed, groups=14, copies=9)
    out = jaccard_join.jaccard_components(documents(spark, texts, extra=True), frequent=frequent, sketch=sketch)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute_components(texts)


def test_jaccard_without_stars_uses_rare_tokens_and_frequent_pairs(spark):
    """Only the index finds the links: no star pairs are given."""
    texts = near_copies(5, groups=10, copies=8)
    docs = documents(spark, texts)
    info = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).mapInArrow(
        jaccard_join._info(5, 1), "_id bigint, n bigint, print binary, keys array<bigint>")
    reps = info.groupBy("print", "n").agg(F.min("_id").alias("node")).select("node", "n")
    none = spark.createDataFrame([], "a bigint, b bigint")
    sets = brute_sets(texts)
    ids = sorted(r["node"] for r in reps.collect())
    want = {(i, j) for i in ids for j in ids if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(want) > 10
    for frequent in (2, 4, 1000):
        got = jaccard_join.links(docs, reps, none, "doc_id", "text", 5, 75, frequent)
        assert {tuple(sorted(r)) for r in got.collect()} == want, frequent


def test_jaccard_null_ids_repeats_and_empty(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q"], ids=[None, 7, 7, None])
    got = sorted(map(str, jaccard_join.op4(docs).collect()))
    assert got == sorted(["Row(doc_id=None, n_shingles=2, component_id=None)", "Row(doc_id=7, n_shingles=2, component_id=7)",
                          "Row(doc_id=7, n_shingles=2, component_id=7)", "Row(doc_id=None, n_shingles=1, component_id=None)"])
    assert jaccard_join.op4(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 150), (150, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 200: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------------------------------- substring dedup
def brute_substrings(texts, window=20):
    seen, out = set(), {}
    for k, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            if x in seen:
                gone[i:i + window] = [True] * window
            seen.add(x)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window,rounds,alphabet", [(20, 4, 200), (20, 4, 2), (7, 3, 5), (20, 6, 30), (4, 1, 3), (20, 0, 50)])
def test_substrings_match_brute_force(spark, window, rounds, alphabet):
    texts = EDGE + near_copies(window, groups=10, copies=4, length=120, alphabet=alphabet) + ["a " * 200 + "b " * 60]
    out = substring_dedup.substring_dedup(documents(spark, texts, extra=True), window=window, rounds=rounds)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out.collect()}
    assert got == brute_substrings(texts, window)


def test_windows_that_collide_in_one_hash_stay_apart(monkeypatch):
    texts = near_copies(5, groups=8) + ["only here " * 12 + f"text {k}" for k in range(3)]
    for name in ("window_hash", "window_check"):
        original = getattr(substring_dedup.Block, name)
        with monkeypatch.context() as m:                  # in this process: Spark's workers would load the module anew
            m.setattr(substring_dedup.Block, name, lambda self, starts, window: original(self, starts, window) % np.uint64(2))
            parts = [(0, len(texts) // 2), (len(texts) // 2, len(texts))]
            tables = [pa.table({"_id": pa.array(range(a, b), pa.int64()), "_text": texts[a:b]}) for a, b in parts]
            names = [substring_dedup._symbols_of(1, 20, 4)((pa.scalar(k),), x) for k, x in enumerate(tables)]
            shared = substring_dedup._shared(pa.concat_tables(names))
            of = lambda table, k: table.filter(pc.equal(table["block"], k))
            windows = [substring_dedup._windows_of(1, 20, 4)((pa.scalar(k),), x, of(shared, k)) for k, x in enumerate(tables)]
            firsts = substring_dedup._firsts(pa.concat_tables(windows))
            out = [substring_dedup._removed_of(20)(x, of(firsts, k)) for k, x in enumerate(tables)]
        got = {i: n for x in out for i, n in zip(x["_id"].to_pylist(), x["n_removed"].to_pylist())}
        assert got == {k: n for k, (_, n, _) in brute_substrings(texts).items()}, name


def test_window_hashes_are_independent():
    block = substring_dedup.Block(pa.table({"_id": pa.array([0], pa.int64()), "_text": [" ".join(f"w{k}" for k in range(2000))]}))
    at = np.arange(1900)
    h, g = block.window_hash(at, 20), block.window_check(at, 20)
    assert len(np.unique(h)) == 1900 and len(np.unique(g)) > 1890
    assert len(np.unique((h >> np.uint64(32)) ^ g)) > 1890 and len(np.unique((h >> np.uint64(32)) - g)) > 1890


def test_substrings_null_ids_and_empty(spark):
    text = " ".join(f"v{k}" for k in range(25))
    docs = documents(spark, [text, text, text, None], ids=[None, 5, 9, 1])
    got = {str(r["doc_id"]): r["n_removed"] for r in substring_dedup.op10(docs).collect()}
    assert got == {"5": 0, "9": 25, "None": 25, "1": 0}
    assert substring_dedup.op10(docs.limit(0)).count() == 0
