import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripsense.llm import bpe, quality
from tripsense.llm.common import table

from .helpers import EDGE, documents
from .test_dedup_and_mix import brute_components


class BruteKneserNey:
    """Interpolated modified Kneser-Ney with plain dictionaries."""

    def __init__(self, texts, order=quality.ORDER):
        self.n = order
        self.count = {order: Counter()}
        for t in texts:
            t = quality._PAD * (order - 1) + t
            self.count[order].update(t[k - order + 1:k + 1] for k in range(order - 1, len(t)))
        for n in range(order - 1, 0, -1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])
        self.discount, self.total, self.spare = {}, {}, {}
        for n, c in self.count.items():
            many = Counter(c.values())
            y = many[1] / (many[1] + 2 * many[2]) if many[1] + many[2] else 0.5
            self.discount[n] = [min(max(k - (k + 1) * y * many[k + 1] / many[k] if many[k] else 0.5, 0.05), k - 0.05) for k in (1, 2, 3)]
            self.total[n], self.spare[n] = Counter(), Counter()
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.spare[n][g[:-1]] += self.discount[n][min(v, 3) - 1]

    def p(self, gram):
        out = 1 / (len(self.count[1]) + 1)
        for n in range(1, self.n + 1):
            g = gram[self.n - n:]
            if total := self.total[n][g[:-1]]:
                v = self.count[n][g]
                own = max(0.0, v - self.discount[n][min(v, 3) - 1]) if v else 0.0
                out = own / total + self.spare[n][g[:-1]] / total * out
        return out

    def log_likelihood(self, text):
        t = quality._PAD * (self.n - 1) + text
        return sum(math.log(self.p(t[k - self.n + 1:k + 1])) for k in range(self.n - 1, len(t)))


def test_log_likelihoods_equal_brute_force(spark):
    train = ["the cat sat on the mat", "the dog sat on the log and the cat", "a mat is not a log"] * 3 + ["été ü 日本"]
    texts = EDGE[:8] + train + ["qqq zzz the", "日", "\U0001F600 the cat"]
    model, unseen = quality.kneser_ney(quality.count_ngrams(documents(spark, train), "text"))
    got = {r["_id"]: r for r in quality.log_likelihoods(documents(spark, texts), model, unseen, "doc_id", "text", "lang").collect()}
    brute = BruteKneserNey(train)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k]["_n"] == len(t or "") and abs(got[k]["_ll"] - brute.log_likelihood(t or "")) < 1e-6


def test_distinct_positions_find_every_value():
    import numpy as np

    for n, kinds in ((0, 1), (10, 3), (50_000, 700), (60_000, 60_000), (20_000, 1)):
        h = quality.mix64(np.random.default_rng(n).integers(0, kinds, n).astype(np.uint64))
        at = quality.distinct_at(h, bits=8)
        assert sorted(h[at].tolist()) == sorted(set(h.tolist()))


def test_classifier_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op2(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = out.join(table(spark, sf, "labels"), "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.02 * len(bad)


def test_fresh_characters_equal_brute_force(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(4)
    texts = ["", "a", "The " * 300, "xy" * 40] + ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 700))) for _ in range(20)]
    codes, own, per = quality.padded(texts)
    hashes = quality._window_hash(codes, own, quality.ORDER)
    grams = [[("\x02" * (quality.ORDER - 1) + t)[k:k + quality.ORDER] for k in range(len(t))] for t in texts]
    fresh = [sum(x not in g[max(0, k - quality.SPAN):k] for k, x in enumerate(g)) for g in grams]
    for at_once in (300, 1 << 18):
        monkeypatch.setattr(quality, "_SORTED_AT_ONCE", at_once)
        assert quality.fresh_characters(hashes, per).tolist() == fresh
    assert quality.fresh_characters(np.zeros(0, np.uint64), np.zeros(2, np.int64)).tolist() == [0, 0]


def test_repeated_words_and_one_outlier(spark):
    """Text that repeats a likely word goes, and one odd trusted text does not raise the threshold."""
    import random

    rng = random.Random(1)
    words = [w.strip(".,") for w in ("the cat sat on a mat and the old dog looked at rain over long green hills while people walked home to "
                                     "read books by the fire until night came with wind from north").split()]
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(900)]
    odd = "zq" + "".join(rng.choice("bcdfghjklmnpqrstvwxz#%") for _ in range(300))
    held = spark.createDataFrame([(k, f"{odd}{k}") for k in range(60)], "k int, t string").filter(quality.held_out("t")).first()["t"]
    texts = good + [held, "the " * 80, " ".join(w for w in words[:6] for _ in range(12)), held[::-1]]
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in quality.classify(docs, spark.range(901).withColumnRenamed("id", "doc_id")).collect()}
    assert [out[k]["kept"] for k in (900, 901, 902, 903)] == [False] * 4
    assert sum(out[k]["kept"] for k in range(900)) >= 0.99 * 900


def test_classifier_edges(spark):
    docs = documents(spark, EDGE, extra=True).withColumn("lang", F.when(F.col("doc_id") > 3, "en"))
    nobody = spark.createDataFrame([], "doc_id bigint")
    assert all(r["kept"] for r in quality.classify(docs, nobody).collect())
    some = spark.createDataFrame([(4,), (5,), (5,), (None,), (999,), (8,)], "doc_id bigint")
    out = quality.classify(docs, some).collect()
    assert len(out) == len(EDGE) and all(r["kept"] for r in out if not EDGE[r["doc_id"]])
    assert quality.classify(docs.limit(0), some).count() == 0


# ------------------------------------------------------------------------------------------- pipeline
def brute_pipeline(rows, trusted):
    """All stages on a list of (doc_id, text, lang, source); without a language's own thresholds (too few documents)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    held = {r[0] for r in spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id bigint, text string")
            .filter(quality.held_out("text")).select("doc_id").collect()}
    model = BruteKneserNey([t or "" for i, t, *_ in rows if i in trusted and i not in held])
    ll = {i: -model.log_likelihood(t or "") for i, t, *_ in rows}
    size = {i: len(t or "") for i, t, *_ in rows}
    rank = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
    known = [i for i in trusted if i in held and size[i]]
    median = rank([ll[i] / size[i] for i in known], 0.5)
    score = {i: (ll[i] + quality.SHRINK * median) / (size[i] + quality.SHRINK) for i in ll}
    top = rank([score[i] for i in known], quality.QUANTILE)
    rows = [r for r in rows if score[r[0]] <= top + quality.SLACK * (top - median)]
    seen, distinct = set(), []
    for r in sorted(rows):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if norm not in seen:
            distinct.append(r)
        seen.add(norm)
    roots = brute_components([r[1] for r in distinct])
    return [r for k, r in enumerate(distinct) if roots[k][1] == k]


@pytest.fixture(scope="module")
def small_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipe"))
    docs = table(spark, "/root/testdata/sf0.001", "documents").filter("n_chars < 900").limit(1000).cache()
    extra = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000)
    empties = spark.createDataFrame([(20_000, None, "en", None, 0), (20_001, "", None, "src0", 0)], docs.schema)
    docs.unionByName(extra).unionByName(empties).repartition(3).write.parquet(f"{folder}/documents.parquet")
    table(spark, "/root/testdata/sf0.001", "labels").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_equals_brute_force(spark, small_folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join",
                                                     "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs = table(spark, small_folder, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    trusted = {r["doc_id"] for r in table(spark, small_folder, "labels").filter("quality = 1").collect()} & {r[0] for r in rows}
    kept = brute_pipeline(rows, trusted)
    state = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        state = stage(spark, state, small_folder)
        assert state.columns == docs.columns
    assert sorted(r["doc_id"] for r in state.collect()) == sorted(r[0] for r in kept)
    text = {r[0]: r[1] or "" for r in kept}
    import public_tokenizers as P
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = corpus_pipeline.run(spark, small_folder).collect()
    copies = Counter(r["doc_id"] for r in out)
    assert set(copies) <= set(text) and max(copies.values()) <= 2
    assert all(r["ids"] == library.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["intact"] for r in out)
    size = {i: len(t.encode().split()) for i, t in text.items()}
    taken = sum(size[i] * n for i, n in copies.items())
    assert 1.5 * sum(size.values()) - max(size.values()) <= taken <= 1.5 * sum(size.values())


def test_pipeline_stages_on_an_empty_table(spark, small_folder):
    empty = table(spark, small_folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small_folder).count() == 0
