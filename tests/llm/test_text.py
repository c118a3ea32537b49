import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripsense.llm import bpe, language_id, spot_signatures
from tripsense.llm.common import table

from .helpers import EDGE, documents, near_copies


# ------------------------------------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def tricky(n=1500):
    rng = random.Random(3)
    parts = ["a", "b", "s", "t", "l", "r", "e", "v", "d", "m", "'", "'", " ", "  ", "\n", "\t", "1", "é", "-", " ", "日", "　", "😀", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_the_library(spark, reference):
    path, library = reference
    texts = EDGE + tricky() + ["=" * 500, "a" * 4000, " " * 300, "é" * 100, "'s't're", "it's'll"]
    rows = bpe.bpe_encode(documents(spark, texts, extra=True), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want
        sizes = [len(library.decode_single_token_bytes(t)) for t in want]
        assert r["offsets"] == [sum(sizes[:k]) for k in range(len(sizes))] if len(sizes) < 200 else True


def test_bpe_round_trip_and_digest(spark, reference):
    path, library = reference
    texts = EDGE + tricky(200)
    docs = documents(spark, texts)
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    for r in bpe.op8(docs).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    odd = documents(spark, ["x", "x"], ids=[None, 2**60 + 1])
    assert {r["doc_id"] for r in bpe.op8(odd).collect()} == {None, 2**60 + 1}
    assert bpe.op8(docs.limit(0)).count() == 0


def test_bpe_round_trip_is_compared(spark, reference):
    path, library = reference
    texts = EDGE + tricky(60)
    for r in bpe.bpe_round_trip(documents(spark, texts, extra=True), path).collect():
        text = (texts[r["doc_id"]] or "").encode()
        assert r["intact"] and r["decoded_sha256"] == hashlib.sha256(text).hexdigest()
        assert b"".join(text[a:b] for a, b in zip(r["offsets"], [*r["offsets"][1:], len(text)])) == text
        assert [library.decode_single_token_bytes(i) for i in r["ids"]] == [text[a:b] for a, b in zip(r["offsets"], [*r["offsets"][1:], len(text)])]


@pytest.mark.parametrize("weak", [lambda n: n * 0, lambda n: n, lambda n: n % 3])
def test_bpe_with_colliding_hashes(reference, weak):
    """Equal hashes of different pieces, in one batch and between batches (by length: pieces of one length collide)."""
    path, library = reference
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.load_ranks(path)), bpe.class_table())
    encoder.hasher = lambda data, starts, ends: weak((ends - starts).astype(np.uint64))
    for batch in (["hello"], ["world"], ["hello", "world"], ["world"], ["a world", "of a hello"], ["hello"]):
        ids, per, _ = encoder.encode([t.encode() for t in batch])
        edge = np.concatenate([[0], np.cumsum(per)])
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [library.encode_ordinary(t) for t in batch]


def test_bpe_cache_between_batches(reference):
    path, library = reference
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.load_ranks(path)), bpe.class_table())
    texts = tricky(600)
    for k in range(0, 600, 50):
        ids, per, _ = encoder.encode([t.encode() for t in texts[k:k + 50] + texts[:20]])
        edge = np.concatenate([[0], np.cumsum(per)])
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [library.encode_ordinary(t) for t in texts[k:k + 50] + texts[:20]]
    assert len(encoder.keys) and encoder.size.sum() == len(encoder.kept)


def test_scan_equals_a_step_by_step_automaton():
    classes = bpe.class_table()
    text = "".join(tricky(300))
    codes = np.array([ord(c) for c in text], np.uint32)
    import regex

    import public_tokenizers as P
    want = [m.start() for m in regex.finditer(P.PATTERN, text)]
    assert bpe.boundaries(codes, np.array([0]), classes).tolist() == want


# ------------------------------------------------------------------------------------------- language ID
def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language_id.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.97


def test_language_mixture_and_edges(spark):
    train = documents(spark, ["the cat and the dog are in the house with them"] * 6 + ["der hund und die katze sind nicht im haus mit ihm"] * 6 + [None, "zzz"])
    train = train.withColumn("lang", F.when(F.col("doc_id") < 6, "en").when(F.col("doc_id") < 12, "de"))
    names, model = language_id.train(train)
    assert names == ["de", "en"]
    docs = documents(spark, [None, "", "12 !!", "the dog and the cat are in the house", "die katze und der hund sind nicht im haus",
                             "the cat and the dog are in the house with them der hund und die katze sind nicht im haus mit ihm"], extra=True)
    got = {r["doc_id"]: r for r in language_id.identify(docs, names, model).collect()}
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in range(3)] == [("und", 0.0)] * 3
    assert got[3]["lang_pred"] == "en" and got[4]["lang_pred"] == "de" and got[3]["score"] == 1.0
    assert set(got[5]["lang_shares"]) == {"de", "en"} and 0.3 < got[5]["lang_shares"]["en"] < 0.7
    nothing = language_id.op1(documents(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).first()
    assert nothing["lang_pred"] == "und"
    assert language_id.op1(docs.limit(0)).count() == 0


def brute_mixture(text, letters, model, penalty):
    """Shares of one text by the method's definition: EM over all languages, then the best penalised prefix of them."""
    counts = {}
    for b in language_id.trigrams([text], letters)[0].tolist():
        counts[b] = counts.get(b, 0) + 1
    n, total = model.shape[1], sum(counts.values())
    if not counts:
        return [0.0] * n

    def em(share, rounds):
        for _ in range(rounds):
            new = [0.0] * n
            for b, c in counts.items():
                w = [float(model[b, j]) * share[j] for j in range(n)]
                for j in range(n):
                    new[j] += c * w[j] / sum(w) / total
            share = new
        return share, sum(c * np.log(sum(float(model[b, j]) * share[j] for j in range(n))) for b, c in counts.items())

    share, _ = em([1 / n] * n, language_id._ROUNDS)
    order = sorted(range(n), key=lambda j: (-share[j], j))
    size = np.log(max(total, 2))
    best, best_score = None, -np.inf
    for k in range(1, n + 1):
        if k > 1 and share[order[k - 1]] <= 1e-3:
            break
        begin = [share[j] if j in order[:k] else 0.0 for j in range(n)]
        found, like = em([x / sum(begin) for x in begin], 0 if k == 1 else language_id._ROUNDS // 2)
        if like - 0.5 * penalty * k * size <= best_score:
            break
        best, best_score = found, like - 0.5 * penalty * k * size
    return best


def test_mixtures_equal_brute_force(spark):
    """Texts of one, two and three languages: proportions and chosen sets are those of the definition."""
    sample = {r["lang"]: r["t"] for r in table(spark, "/root/testdata/sf0.001", "documents").filter("n_chars > 400").groupBy("lang")
              .agg(F.max_by(F.substring("text", 1, 400), "doc_id").alias("t")).collect()}
    names, model = language_id.train(table(spark, "/root/testdata/sf0.001", "documents"))
    letters = language_id.letter_table()
    assert names == sorted(names) and len(names) == 4 and np.allclose(model.sum(axis=0), 1, atol=1e-3)
    a, b, c, _ = (sample[x] for x in names)
    texts = [a, b, a + " " + b, a[:200] + " " + b + " " + c, a[:30], "x", "12", c * 3, a[:60] + " " + c]
    got = language_id.infer(texts, letters, model)
    want = np.array([brute_mixture(t, letters, model, language_id.PENALTY) for t in texts])
    assert np.allclose(got, want, atol=1e-6) and ((got > 0) == (want > 0)).all()
    assert [(g > 0).sum() for g in got[:3]] == [1, 1, 2]


def test_language_ties_long_texts_and_repeated_rows(spark):
    model = np.full((language_id.BINS, 3), 1 / language_id.BINS, np.float32)  # three languages that explain all alike
    long = "Some words of a long text, again and again. " * 20_000
    docs = documents(spark, ["any text", long, "any text", "any text"], extra=True, ids=[1, 2, 1, 3])
    rows = language_id.identify(docs, ["aa", "bb", "cc"], model).collect()
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(i, "aa", 1.0) for i in (1, 1, 2, 3)]
    many = documents(spark, ["text"] * (language_id.MAX_LANGUAGES + 1)).withColumn("lang", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError):
        language_id.train(many)


# ------------------------------------------------------------------------------------------- spot signatures
def brute_signatures(text):
    import re

    anchors = set(spot_signatures.ANCHORS) | {"^"}
    w = ["^"] + [x for x in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if x]
    out = set()
    for k, x in enumerate(w):
        if x in anchors and k + 1 < len(w) and w[k + 1] not in anchors:
            chain = [y for y in w[k + 1:] if y not in anchors][:spot_signatures.CHAIN]
            if chain:
                out.add((x, *chain))
    return out


def test_signatures_follow_the_anchors(spark):
    texts = ["The cat of the big dog, and a mouse", "big dog", "the of and", "!!!", "", "Über die Brücke und der Weg", "x1 the 22", "the the and of " * 3000 + "dog",
             "and " * 50_000, "cat the " * 20_000] + [t.replace(" w1", " the w1") for t in near_copies(4)[:20]]
    rows = documents(spark, texts).select("doc_id", spot_signatures.signatures(F.col("text")).alias("s")).collect()
    for r in rows:
        want = brute_signatures(texts[r["doc_id"]])
        assert len(r["s"]) == (len(want) or int(bool(texts[r["doc_id"]]))), texts[r["doc_id"]]
    assert len({tuple(r["s"]) for r in rows}) == len({frozenset(brute_signatures(t)) or t for t in texts})


def test_texts_without_anchors_count_whole(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("kqxzwv") for _ in range(6))
    body, other, few = [word() for _ in range(600)], [word() for _ in range(600)], [word() for _ in range(9)]
    at = body[:300] + ["the"] + body[300:]
    texts = [" ".join(x) for x in (["ab", "cd", *body], ["ab", "cd", *other], ["ef", "gh", "ij", *body], ["ab", "cd", *at],
                                   ["ab", "cd", *few], ["ab", "cd", *few[:-1], "kk"], [word() for _ in range(60_000)])]
    s = {r["doc_id"]: set(r["signatures"]) for r in spot_signatures.fingerprints(documents(spark, texts)).collect()}
    like = lambda a, b: len(s[a] & s[b]) / len(s[a] | s[b])
    assert len(s[0]) == 601 and like(0, 1) < 0.01 and like(0, 2) > 0.98 and like(0, 3) > 0.95
    assert len(s[4]) == 10 and 0.7 < like(4, 5) < 1 and len(s[6]) > 59_000
    pairs, members = spot_signatures.near_duplicates(documents(spark, texts))
    assert {(r["left_id"], r["right_id"]) for r in pairs.collect()} == {(0, 2), (0, 3), (2, 3), (4, 5)}
    assert len({r["class_id"] for r in members.collect()}) == 7
    # as many words between anchors as start no chains, and one more
    run = lambda n: "the " + " ".join(f"k{k}" for k in range(n + 1)) + " the end"
    few_rows = spot_signatures.fingerprints(documents(spark, [run(spot_signatures.SPARSE - 1), run(spot_signatures.SPARSE)])).collect()
    assert [len(r["signatures"]) for r in sorted(few_rows, key=lambda r: r["doc_id"])] == [2, 2 + spot_signatures.SPARSE]


@pytest.mark.parametrize("n,partitions", [(1, 4), (2, 4), (60, 4), (60, 1), (23, 16)])
def test_neighbours_and_likeness(spark, n, partitions):
    texts = (EDGE + near_copies(6))[:n]
    ids = [(k * 37) % 101 - 20 for k in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r["doc_id"]: r for r in spot_signatures.op9(documents(spark, texts, extra=True, ids=ids)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == n
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % n][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[i]["near_edited"] == 1.0 and got[i]["fingerprint"] == got[i]["edited_fingerprint"]
        a, b = ({x[j:j + 8] for j in range(0, len(x), 8)} for x in (got[i]["fingerprint"], got[order[(k + 1) % n][0]]["fingerprint"]))
        assert abs(got[i]["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_spot_near_duplicates_lose_no_pair(spark):
    texts = [t.replace(" ", " the ") for t in near_copies(8, groups=8)] + [None, ""]
    docs = documents(spark, texts)
    pairs, members = spot_signatures.near_duplicates(docs, threshold=0.6)
    sets = {r["doc_id"]: set(r["signatures"]) for r in spot_signatures.fingerprints(docs).collect()}
    cls = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert all(cls[k] == min(j for j in sets if sets[j] == s) for k, s in sets.items())
    reps = sorted(set(cls.values()))
    want = {(i, j) for i in reps for j in reps if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert {(r["left_id"], r["right_id"]) for r in pairs.collect()} == want and want


def test_spot_edges(spark):
    docs = documents(spark, ["a", "b", "a"], ids=[None, 4, 4])
    assert spot_signatures.op9(docs).count() == 3
    assert spot_signatures.op9(docs.limit(0)).count() == 0
