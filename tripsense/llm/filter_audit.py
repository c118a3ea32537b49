"""Filter interaction audit: what each filter removes at each place of every filter order.

Every row gets a failure mask, one bit a filter, and masks are counted per part by a partial
aggregate: whatever the size of a part, a task sends at most ``2^filters`` counts of it. One
decision diagram per part is then built from those counts: a level tests one filter, nodes
with equal content are shared, and every node weighs the rows (and good and toxic rows) below
it. The orders are walked so that each differs from the one before by swapping two adjacent
levels, which rebuilds the nodes of the upper level alone. In each order the path on which all
filters pass gives the steps: the failing branch at a level is what the filter removes there,
the passing branch what it keeps. Parts are independent and stay spread over the tasks.

Identical texts are found by SHA-256 of the whole text: the smallest id of each hash comes from
a partial aggregate and is joined back on hash *and* id, so no hash is a hot join key.

Defined results: NULL text counts as empty; a NULL part is the part ``''``; a row without id is
never the smaller copy and never fails for an earlier one; rows that repeat the smallest id of a text do not fail for it either; a
document counts as good (toxic) if any row of the labels table with its id says so, NULL flags
say nothing; an empty table gives an empty result; other columns are not read, whatever their
names. The work grows with the factorial of the number of filters (5 here: 120 orders).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsense.llm.common import SPACE, text_or_empty
from tripsense.session import materialize

#: thresholds of the five production filters
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
ORDER_SCHEMA = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
                "unique_fails long, good_lost long, toxic_lost long, shapley long")


# ------------------------------------------------------------------------------------------- diagram
class Diagram:
    """A quasi-reduced decision diagram over failure masks; leaves and nodes weigh (rows, good, toxic).

    Node 0 is the diagram of no rows at any level. Other nodes are ``(pass child, fail child)``, shared by content within a
    level; children of the lowest level are leaves, shared by weight.
    """

    def __init__(self, names: Sequence[str], counts: dict[int, tuple[int, int, int]]):
        self.order = list(names)
        self.children: list[tuple[int, int] | None] = [None]
        self.weight: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.shared: list[dict] = [{} for _ in range(len(self.order) + 1)]
        level = {mask: self._node(len(self.order), None, w) for mask, w in counts.items()}
        for at in range(len(self.order) - 1, -1, -1):
            bit = 1 << at
            level = {mask: self._node(at, (level.get(mask, 0), level.get(mask | bit, 0)))
                     for mask in {m & ~bit for m in level}}
        self.root = level.get(0, 0)

    def _node(self, level: int, children: tuple[int, int] | None, weight=None) -> int:
        if children == (0, 0) or weight == (0, 0, 0):
            return 0
        found = self.shared[level].get(children if weight is None else weight)
        if found is None:
            found = len(self.weight)
            if weight is None:
                weight = tuple(a + b for a, b in zip(self.weight[children[0]], self.weight[children[1]]))
                self.shared[level][children] = found
            else:
                self.shared[level][weight] = found
            self.children.append(children)
            self.weight.append(weight)
        return found

    def branches(self, node: int) -> tuple[int, int]:
        return self.children[node] or (0, 0)

    def swap(self, at: int) -> None:
        """Exchange the levels ``at`` and ``at + 1``; what lies above and below keeps its nodes."""
        below = self.shared[at + 1] = {}
        moved: dict[int, int] = {0: 0}
        for children, node in list(self.shared[at].items()):
            (pass_pass, pass_fail), (fail_pass, fail_fail) = map(self.branches, children)
            moved[node] = node
            self.children[node] = (self._node(at + 1, (pass_pass, fail_pass)), self._node(at + 1, (pass_fail, fail_fail)))
        self.shared[at] = {self.children[node]: node for node in moved if node}
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]

    def steps(self) -> list[tuple[str, tuple[int, int, int], tuple[int, int, int]]]:
        """``(filter, weight kept, weight removed)`` along the path on which everything passes."""
        node, out = self.root, []
        for name in self.order:
            passing, failing = self.branches(node)
            out.append((name, self.weight[passing], self.weight[failing]))
            node = passing
        return out

    def only_fails(self) -> dict[str, int]:
        """Rows that fail one filter alone: the leaf behind one failing branch of the all-pass path."""
        node, out = self.root, {}
        for at, name in enumerate(self.order):
            passing, leaf = self.branches(node)
            for _ in range(at + 1, len(self.order)):
                leaf = self.branches(leaf)[0]
            out[name] = self.weight[leaf][0]
            node = passing
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the adjacent swaps that lead through all orders of ``n`` things: the last thing sweeps
    down and up through each order of the others."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at
        down = not down


def audit_counts(names: Sequence[str], counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """All rows ``(order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``
    of one part, from its counts by failure mask (bit k: filter k fails)."""
    diagram = Diagram(names, counts)
    unique, fails, shapley, walked = diagram.only_fails(), {}, dict.fromkeys(names, 0), []
    swaps = adjacent_swaps(len(names))
    while True:
        steps = diagram.steps()
        fails[steps[0][0]] = steps[0][2][0]  # nothing was removed before the first filter
        for name, _, removed in steps:
            shapley[name] += removed[0]
        walked.append(("".join(diagram.order), steps))
        at = next(swaps, None)
        if at is None:
            break
        diagram.swap(at)
    return [(order, k, name, kept[0], removed[0], fails[name] - removed[0], unique[name], removed[1], removed[2], shapley[name])
            for order, steps in walked for k, (name, kept, removed) in enumerate(steps, 1)]


# ----------------------------------------------------------------------------------------- operator
def mask_counts(rows: DataFrame, part: str, fails: dict[str, str], good: str, toxic: str) -> DataFrame:
    """``part, counts``: at most ``2^filters`` entries ``(mask, n, good, toxic)`` a part, from boolean columns."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("long")
    mask = sum((flag(name) * F.lit(1 << k) for k, name in enumerate(fails.values())), F.lit(0).cast("long"))
    return (rows.groupBy(F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(flag(good)).alias("good"), F.sum(flag(toxic)).alias("toxic"))
            .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")))


def filter_audit(rows: DataFrame, part: str, fails: dict[str, str], good: str, toxic: str) -> DataFrame:
    """One row per part, filter order and step. ``fails``: one-letter filter name -> boolean failure column."""
    names = list(fails)
    if not names or any(len(n) != 1 for n in names):
        raise ValueError("filters need names of one letter")
    columns = [f.split(" ")[0] for f in ORDER_SCHEMA.split(", ")[1:]]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, counts in zip(batch["part"], batch["counts"]):
                out = audit_counts(names, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts})
                yield pd.DataFrame(out, columns=columns).assign(part=at)[["part", *columns]]

    return mask_counts(rows, part, fails, good, toxic).mapInPandas(walk, ORDER_SCHEMA)


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides (``E`` needs the other texts)."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < MIN_WORDS,
            "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * MIN_DISTINCT_PCT,
            "C": upper.cast("long") * 100 > F.length(text).cast("long") * MAX_UPPER_PCT,
            "D": text.rlike(SYMBOLS)}


def production_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``A`` to ``E`` (failures), ``good``, ``toxic`` per row of ``docs``; the texts are read once."""
    text = text_or_empty("text")
    rows = materialize(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"),
                                   F.unhex(F.sha2(text, 256)).alias("hash"),
                                   *[c.alias(k) for k, c in text_failures(text).items()]))
    first = rows.groupBy("hash").agg(F.min("id").alias("id")).select("hash", "id", F.lit(True).alias("first"))
    said = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
            .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    return (rows.join(first, ["hash", "id"], "left").join(said, "id", "left")
            .select("part", "A", "B", "C", "D", (F.col("first").isNull() & F.col("id").isNotNull()).alias("E"), "good", "toxic"))


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = filter_audit(production_failures(docs, labels), "part", {k: k for k in "ABCDE"}, "good", "toxic")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(first_id < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(ch, bit)),
o AS (SELECT a.ch || b.ch || c.ch || d.ch || e.ch AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before
  FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
