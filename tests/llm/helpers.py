"""Small tables and brute-force versions for the tests of the training-data operators."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=False, ids=None):
    """A documents table of the given texts; ``extra``: with columns whose names the operators use inside."""
    rows = [(k if ids is None else ids[k], t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F
        for name in ("block", "_id", "_text", "keep_id", "_h", "_size", "shard", "n", "node", "gram", "size", "target", "_key"):
            df = df.withColumn(name, F.lit("clash"))
    return df


EDGE = [None, "", " ", "\n\t", "one", "One  two\nthree", "a b c d e", "A B C D E", "x " * 3000, "x " * 3000, "word " * 19, "word " * 20,
        "word " * 21, None, "é ü 日本 語", "tab\tand\x0bvt and nbsp here", "don't we'll 'tis  12 345!!", "\U0001F600 \U0001F600"]


def words(text):
    """Words at ASCII white space, as UTF-8 bytes."""
    return (text or "").encode("utf-8").split()


def near_copies(seed=0, groups=12, copies=6, length=60, alphabet=200):
    """Texts in groups of edited copies, with a passage that many share."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(alphabet)]
    passage = [rng.choice(vocab) for _ in range(25)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, length))]
        if g % 2:
            at = rng.randint(0, len(base))
            base[at:at] = passage
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        out.append(" ".join(base))
    rng.shuffle(out)
    return out
