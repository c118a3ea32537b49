import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, EDGE
from tripsense.llm.filter_audit import adjacent_swaps, audit_counts, filter_audit, op11, production_failures

LABELS = "doc_id bigint, quality int, toxic int"


def brute(names, rows):
    """``rows``: (mask, good, toxic) of one part."""
    out, shapley = [], dict.fromkeys(names, 0)
    for order in itertools.permutations(range(len(names))):
        alive, done = list(rows), 0
        for step, f in enumerate(order, 1):
            removed = [r for r in alive if r[0] >> f & 1]
            alive = [r for r in alive if not r[0] >> f & 1]
            redundant = sum(1 for r in rows if r[0] >> f & 1 and r[0] & done)
            done |= 1 << f
            shapley[names[f]] += len(removed)
            out.append(("".join(names[x] for x in order), step, names[f], len(alive), len(removed), redundant,
                        sum(r[0] == 1 << f for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed)))
    return sorted(r + (shapley[r[2]],) for r in out)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6])
def test_swaps_lead_through_all_orders(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in adjacent_swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_diagram_equals_filtering(n):
    rng, names = random.Random(n), "ABCDE"[:n]
    for size in (0, 1, 4, 80):
        rows = [(rng.randrange(2**n), rng.random() < 0.4, rng.random() < 0.2) for _ in range(size)]
        counts = {}
        for mask, good, toxic in rows:
            c = counts.get(mask, (0, 0, 0))
            counts[mask] = (c[0] + 1, c[1] + good, c[2] + toxic)
        assert sorted(audit_counts(names, counts)) == brute(names, rows)


def expected(docs, labels):
    """Brute force of the query from rows (doc_id, text, lang) and (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text),
                 doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)]
        parts.setdefault(lang or "", []).append((sum(f << k for k, f in enumerate(fails)), doc_id in good, doc_id in toxic))
    return sorted((part, r[0], r[1], *r[3:]) for part, rows in parts.items() for r in brute("ABCDE", rows))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    texts = EDGE + ["SHOUT " * 210, "a%b", "Word$ " * 250] + [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(6)]
    texts += rng.choices(texts, k=40) + ["u" * 50_000]  # copies, also across parts, and a long text
    docs = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    docs += [docs[3], docs[12], (None, "one", "en"), (None, None, None), (7, "another text under an id in use", "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 70)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], DOCS)
    for clash in ("part", "hash", "id", "first", "A", "E", "good", "mask", "counts", "step"):
        frame = frame.withColumn(clash, F.lit("clash"))
    got = op11(frame.repartition(7), spark.createDataFrame(labels, LABELS).withColumn("id", F.lit("clash")))
    assert rows_of(got) == expected(docs, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert op11(none, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert rows_of(op11(one, spark.createDataFrame([], LABELS))) == expected([(1, None, None)], [])


def test_general_interface_and_one_row_a_task(spark):
    rows = spark.createDataFrame([("p", k % 2 == 0, k % 3 == 0, True, False) for k in range(12)] + [(None, None, True, None, True)],
                                 "region string, odd boolean, third boolean, nice boolean, bad boolean")
    got = {tuple(r) for r in filter_audit(rows, "region", {"X": "odd", "Y": "third"}, "nice", "bad").collect()}
    assert ("p", "XY", 1, "X", 6, 6, 0, 4, 6, 0, 10) in got and ("p", "YX", 2, "X", 4, 4, 2, 4, 4, 0, 10) in got
    assert ("", "XY", 2, "Y", 0, 1, 0, 1, 0, 1, 2) in got
    with pytest.raises(ValueError):
        filter_audit(rows, "region", {"long": "odd"}, "nice", "bad")


def test_copies_are_not_a_hot_join_key(spark):
    docs = spark.createDataFrame([(k, "the same text", "en", "s", 13) for k in range(300)], DOCS)
    out = production_failures(docs, spark.createDataFrame([], LABELS))
    assert out.filter("E").count() == 299
    assert "hash" in out._jdf.queryExecution().toString() and "(hash#" in out._jdf.queryExecution().toString()
