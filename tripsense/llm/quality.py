"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Tokens are characters, the order is ``ORDER``. Training: every task counts the n-grams of its
trusted documents, the counts are summed by n-gram, and continuation counts, discounts,
back-off weights and interpolated probabilities follow from aggregations and joins of the
n-gram tables (sharded by n-gram, nothing is gathered on the driver but five rows of
discounts).

Scoring: documents are shuffled once into blocks. Every block lists the distinct n-grams it
needs (as 48-bit hashes), the lists meet the model's shards (the sharded count join), and the
answers come back to the block, where each document's log likelihood is summed. So a frequent n-gram
travels once a block, not once an occurrence, and no task holds more than its block's part of
the model.

A fifth of the trusted texts (by text hash, so copies stay together) is held out of training;
the thresholds come from it. A document's mean negative log likelihood is drawn towards its language's median by
``SHRINK`` characters (short texts say little). It is rejected above the language's threshold:
the ``QUANTILE`` of the held-out documents (plus ``SLACK`` times that quantile's distance from the
median). A language with too few of them to have that quantile adds to its median the quantile of
all languages' distances from their medians; with fewer than ``MIN_TRUSTED`` it uses the threshold of all.

Repeated words are likely to the model, so a second measure has a lower limit: the share of fresh
characters, whose n-gram of the highest order does not occur in the ``SPAN`` characters before, drawn
towards its median likewise. It needs no training, so the limit is the ``LOW`` quantile of all
trusted documents of the language, or of all languages if it has too few (no limit with fewer than
``MIN_TRUSTED`` in all).

Defined results: NULL or empty text has nothing against it (0 tokens, kept); a NULL language is
judged by the thresholds of all; without any trusted text everything is kept; repeated rows
repeat their result; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsense.llm.blocks import Positions, block_count, dealt, packed, packed_blocks, shard_rows, unpack, unpacked
from tripsense.llm.common import broadcast_if_small, text_or_empty
from tripsense.llm.segments import mix64, slices
from tripsense.session import materialize

ORDER = 5
QUANTILE = 0.99
SLACK = 0.0
LOW = 0.0025
SPAN = 256
SHRINK = 64.0
MIN_TRUSTED = 30
HOLD_OUT = 5
_KEPT_BY_TASK = 2_000_000
_SORTED_AT_ONCE = 1 << 18
_KEY_BYTES = 6
_PAD = "\x02"
_MULTIPLIERS = mix64(np.arange(1, 2 * ORDER + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the rows of a matrix of code points (its width counts too)."""
    n = codes.shape[1]
    out = np.full(len(codes), _MULTIPLIERS[ORDER + n], np.uint64)
    for k in range(n):
        out += codes[:, n - 1 - k].astype(np.uint64) * _MULTIPLIERS[k]
    return mix64(out)


def _window_hash(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(at), _MULTIPLIERS[ORDER + n], np.uint64)
    for k in range(n):
        out += codes[at - k].astype(np.uint64) * _MULTIPLIERS[k]
    return mix64(out)


def distinct_at(hashes: np.ndarray, bits: int = 20) -> np.ndarray:
    """One position of every distinct value: rounds of scattering positions into a table by some of the
    bits; values that lost their place go on with other bits, and what is left is sorted."""
    rest, found = np.arange(len(hashes)), []
    table = np.full(1 << bits, -1, np.int64)
    for shift in (44, 33, 22, 11, 0):
        if len(rest) < 4096:
            break
        h = hashes[rest]
        slot = ((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        table[:] = -1
        table[slot] = rest
        found.append(table[table >= 0])
        rest = rest[hashes[table[slot]] != h]
    found.append(rest[np.unique(hashes[rest], return_index=True)[1]])
    return np.concatenate(found)


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with padding before every text; positions of the texts' own characters; their number a text."""
    gap = _PAD * (ORDER - 1)
    codes = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    per = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(per + ORDER - 1) - per
    total = int(per.sum())
    own = np.arange(total) + np.repeat(begin - (np.cumsum(per) - per), per)
    return codes, own, per


def fresh_characters(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """How many positions of every text have an n-gram that its ``SPAN`` positions before have not.

    ``hashes``: of the n-grams ending at the positions; ``per``: positions a text.
    """
    text = np.repeat(np.arange(len(per), dtype=np.int32), per)
    fresh = per.astype(np.int64)
    for begin in range(0, len(hashes), _SORTED_AT_ONCE):
        first = max(0, begin - SPAN)
        h = hashes[first:begin + _SORTED_AT_ONCE]
        order = np.argsort(h, kind="stable")
        before, at = order[:-1], order[1:]
        again = at[(h[before] == h[at]) & (at - before <= SPAN)
                   & (text[first + before] == text[first + at]) & (first + at >= begin)]
        fresh -= np.bincount(text[first + again], minlength=len(per))
    return fresh


def _strings(codes: np.ndarray) -> list[str]:
    n = codes.shape[1]
    whole = np.ascontiguousarray(codes, np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[k:k + n] for k in range(0, len(whole), n)]


def count_ngrams(texts: DataFrame, text_col: str) -> DataFrame:
    """``(gram, c)``: occurrences of every n-gram of the highest order."""
    def count(stream):
        import pyarrow as pa

        seen, codes_of, total = np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)

        def send():
            return pa.RecordBatch.from_arrays([pa.array(_strings(codes_of), pa.string()), pa.array(total, pa.int64())], ["gram", "c"])

        for batch in stream:
            all_texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(all_texts):
                codes, own, _ = padded(all_texts[a:b])
                h = _window_hash(codes, own, ORDER)
                rep = distinct_at(h)
                rep = rep[np.argsort(h[rep])]
                n = np.bincount(Positions(h[rep])(h), minlength=len(rep)) if len(rep) else total[:0]
                both = np.concatenate([seen, h[rep]])
                seen, first, at = np.unique(both, return_index=True, return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([total, n]), minlength=len(seen)).astype(np.int64)
                codes_of = np.concatenate([codes_of, codes[own[rep][:, None] - np.arange(ORDER - 1, -1, -1)]])[first]
                if len(seen) > _KEPT_BY_TASK:
                    yield send()
                    seen, codes_of, total = seen[:0], codes_of[:0], total[:0]
        if len(seen):
            yield send()

    return texts.select(F.col(text_col)).mapInArrow(count, "gram string, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """The model ``(gram, logp, logb)`` of all orders and the log probability of an unseen character.

    ``logp``: interpolated probability of the last character after the others; ``logb``: back-off
    weight of the n-gram as a context (NULL where it is none).
    """
    level = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):                     # continuation counts
        level[n] = level[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    grams = materialize(reduce(DataFrame.unionByName, [level[n].withColumn("n", F.lit(n)) for n in level]))
    of = {r["n"]: r for r in grams.groupBy("n").agg(
        F.count(F.lit(1)).alias("kinds"), *[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)]).collect()}
    if not of:
        return grams.select("gram", F.lit(0.0).alias("logp"), F.lit(0.0).alias("logb")), 0.0

    def discounts(r) -> list[float]:
        y = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] + r["n2"] else 0.5
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * r[f"n{k + 1}"] / r[f"n{k}"] if r[f"n{k}"] else 0.5
            out.append(min(max(d, 0.05), k - 0.05))
        return out

    d = {n: discounts(r) for n, r in of.items()}
    uniform = 1.0 / (of[1]["kinds"] + 1)
    by_n = lambda k: F.element_at(F.create_map(*[x for n in d for x in (F.lit(n), F.lit(d[n][k]))]), F.col("n"))
    off = F.when(F.col("c") >= 3, by_n(2)).when(F.col("c") == 2, by_n(1)).otherwise(by_n(0))
    context = F.substring(F.col("gram"), F.lit(1), F.col("n") - 1)
    within = Window.partitionBy("n", "context")
    parts = (grams.withColumn("context", context).withColumn("d", off)
             .withColumns({"total": F.sum("c").over(within), "spare": F.sum("d").over(within)})
             .select("n", "gram", "context", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"),
                     (F.col("spare") / F.col("total")).alias("back")))
    parts = materialize(parts)
    first = parts.filter("n = 1")
    back1 = first.select("back").first()[0]
    lower = first.select("gram", (F.col("own") + F.col("back") * F.lit(uniform)).alias("p"))
    tables = [lower]
    for n in range(2, ORDER + 1):
        below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("p_low"))
        lower = (parts.filter(F.col("n") == n).withColumn("suffix", F.substring("gram", 2, n - 1)).join(below, "suffix")
                 .select("gram", (F.col("own") + F.col("back") * F.col("p_low")).alias("p")))
        tables.append(lower)
    probs = reduce(DataFrame.unionByName, tables).select("gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logb"))
    backs = (parts.filter("n > 1").groupBy("context").agg(F.first("back").alias("back"))
             .select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("back").alias("logb")))
    model = probs.unionByName(backs).groupBy("gram").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb"))
    return materialize(model), float(np.log(back1 * uniform))


_ROWS = "shard int, block int, keys binary, more binary"


def _table(pa, rows):
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["shard", "block", "keys", "more"])


def _name(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - 8 * _KEY_BYTES)


def _block_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block's distinct n-grams of the highest order, and the names of all orders' n-grams."""
    rows = np.zeros((0, ORDER), np.uint32)
    for a, b in slices(texts):
        codes, own, _ = padded(texts[a:b])
        rep = distinct_at(_window_hash(codes, own, ORDER))
        rows = np.concatenate([rows, codes[own[rep][:, None] - np.arange(ORDER - 1, -1, -1)]])
        rows = rows[distinct_at(gram_hash(rows))]
    keys = [gram_hash(rows)]
    for n in range(1, ORDER):
        keys += [gram_hash(rows[:, ORDER - n:]), gram_hash(rows[:, ORDER - 1 - n:ORDER - 1])]
    return rows, np.unique(_name(np.concatenate(keys)))


def _needed(shards: int):
    """The n-grams of a block to their shards."""
    def run(key, table):
        import pyarrow as pa

        _, keys = _block_grams(unpack(table, 4)[1])
        return _table(pa, [(s, key[0].as_py(), packed(keys[k], _KEY_BYTES), None) for s, k in shard_rows(keys, shards)])
    return run


def _sharded(shards: int):
    """The model's n-grams as hashes with their shard."""
    def run(stream):
        import pyarrow as pa

        for batch in stream:
            grams = batch.column(0).to_pylist()
            length = np.array([len(g) for g in grams], np.int64)
            keys = np.zeros(len(grams), np.uint64)
            for n in range(1, ORDER + 1):
                at = np.flatnonzero(length == n)
                if len(at):
                    text = "".join(grams[k] for k in at)
                    keys[at] = gram_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n))
            keys = _name(keys)
            yield pa.RecordBatch.from_arrays([pa.array((keys % np.uint64(shards)).astype(np.int32)), pa.array(keys.view(np.int64)),
                                              batch.column(1), batch.column(2)], ["shard", "key", "logp", "logb"])
    return run


def _join(key, left, right):
    """The count join of a shard: for each block which of its n-grams the model has, and both values, in order."""
    import pyarrow as pa

    keys = right.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    values = np.stack([np.array(right.column(c).to_numpy(), np.float32)[order] for c in ("logp", "logb")], axis=1)
    rows = []
    for block, asked in zip(left.column("block").to_pylist(), left.column("keys").to_pylist()):
        asked = unpacked(asked, _KEY_BYTES)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[at] == asked
            rows.append((key[0].as_py(), block, np.packbits(hit).tobytes(), values[at[hit]].tobytes()))
    return _table(pa, rows)


class _Scorer:
    """Log probabilities of a block's n-grams of the highest order from its part of the model."""

    def __init__(self, texts: list[str], answers, shards: int, unseen: float):
        self.unseen = unseen
        rows, self.keys = _block_grams(texts)
        self.logp, self.logb = np.full((2, len(self.keys)), np.nan)
        mine = dict(shard_rows(self.keys, shards))
        for shard, hit, value in zip(*(answers.column(c).to_pylist() for c in ("shard", "keys", "more"))):
            at = mine[shard]
            at = at[np.unpackbits(np.frombuffer(hit, np.uint8), count=len(at)).astype(bool)]
            self.logp[at], self.logb[at] = np.frombuffer(value, np.float32).reshape(-1, 2).T
        hashes = gram_hash(rows)
        order = np.argsort(hashes)
        self.value = self(rows[order]) if len(rows) else np.zeros(0)
        self.position = Positions(hashes[order])

    def _find(self, codes: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values[np.searchsorted(self.keys, _name(gram_hash(codes)))]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out, back = np.full(len(rows), np.nan), np.zeros(len(rows))
        for n in range(ORDER, 0, -1):
            open_ = np.flatnonzero(np.isnan(out))
            if not len(open_):
                break
            p = self._find(rows[open_, ORDER - n:], self.logp)
            out[open_] = p + back[open_]
            if n > 1:
                back[open_] += np.nan_to_num(self._find(rows[open_, ORDER - n:ORDER - 1], self.logb))
        return np.where(np.isnan(out), back + self.unseen, out)

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the log probabilities of every text's characters, and how many of them are fresh."""
        codes, own, per = padded(texts)
        if not len(own):
            return np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        hashes = _window_hash(codes, own, ORDER)
        fresh = fresh_characters(hashes, per)
        value = self.value[self.position(hashes)]
        run = np.concatenate([[0.0], np.cumsum(value)])
        edge = np.concatenate([[0], np.cumsum(per)])
        return run[edge[1:]] - run[edge[:-1]], fresh


def log_likelihoods(docs: DataFrame, model: DataFrame, unseen: float, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Per row: ``_id``, ``_lang``, ``_held``, ``_n`` characters, ``_ll`` their log likelihood and ``_fresh`` how many are fresh."""
    n_blocks = block_count(docs, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)).cast("int").alias("block"), "_id", "_text", "_lang",
                       held_out("_text").alias("_held"))
    blocks = packed_blocks(rows, n_blocks)                # the only shuffle of the texts; both uses below share it
    id_type = dict(docs.dtypes)[id_col]
    asked = blocks.groupBy("block").applyInArrow(_needed(n_blocks), _ROWS)
    sharded = model.select("gram", "logp", "logb").mapInArrow(_sharded(n_blocks), "shard int, key bigint, logp double, logb double")
    answers = (dealt(asked, n_blocks, "shard").groupBy("shard").cogroup(dealt(sharded, n_blocks, "shard").groupBy("shard"))
               .applyInArrow(_join, _ROWS))

    def score(left, right):
        import pyarrow as pa

        ids, texts, langs, held = unpack(left, 4)
        scorer = _Scorer(texts, right, n_blocks, unseen)
        parts = [scorer.documents(texts[a:b]) for a, b in slices(texts)]
        arrow = pa.schema([("_id", id_arrow), ("_lang", pa.string()), ("_held", pa.bool_()), ("_n", pa.int64()), ("_ll", pa.float64()),
                           ("_fresh", pa.int64())])
        sums = [np.concatenate(x) for x in zip(*parts)] if parts else [[], []]
        return pa.table([ids, langs, held, [len(t) for t in texts], *sums], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_type
    id_arrow = to_arrow_type(docs.schema[id_col].dataType)
    return blocks.groupBy("block").cogroup(dealt(answers, n_blocks, "block").groupBy("block")).applyInArrow(
        score, f"_id {id_type}, _lang string, _held boolean, _n bigint, _ll double, _fresh bigint")


def held_out(text_col: str):
    """The part of the texts that sets thresholds and trains nothing."""
    return F.pmod(F.xxhash64(text_or_empty(text_col)), F.lit(HOLD_OUT)) == 0


def trusted_texts(docs: DataFrame, trusted: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``trusted``; its ids are broadcast after a check of their size only."""
    ids = trusted.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    return docs.join(broadcast_if_small(ids, row_bytes=16), id_col, "left_semi")


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             quantile: float = QUANTILE, slack: float = SLACK, shrink: float = SHRINK, min_trusted: int = MIN_TRUSTED,
             low: float = LOW) -> DataFrame:
    """Per document: id, language, ``n_tokens``, ``perplexity``, ``score`` (shrunk mean negative log
    likelihood), ``threshold``, ``freshness`` (shrunk share of fresh characters), ``floor`` and ``kept``.
    ``trusted``: ids of documents whose text is good."""
    train = trusted_texts(docs, trusted, id_col).filter(~held_out(text_col))
    model, unseen = kneser_ney(materialize(count_ngrams(train, text_col)))
    scored = materialize(log_likelihoods(docs, model, unseen, id_col, text_col, lang_col))
    mean = F.when(F.col("_n") > 0, -F.col("_ll") / F.col("_n"))
    scored = scored.withColumn("_mean", mean)
    good = trusted_texts(scored.withColumnRenamed("_id", id_col), trusted, id_col).filter("_mean IS NOT NULL")
    known = good.filter("_held")
    middle = F.percentile_approx("_mean", 0.5, 10000)
    # one row a language; quantile sketches are merged, no group is gathered
    medians = known.groupBy("_lang").agg(middle.alias("median"), F.count(F.lit(1)).alias("docs"))
    all_median = known.agg(middle).first()[0]
    medians = materialize(medians.filter((F.col("docs") >= min_trusted) & F.col("_lang").isNotNull()).select("_lang", "median", "docs"))
    by_lang = broadcast_if_small(medians.drop("docs"), row_bytes=64)   # else one language's rows would meet in a task
    drawn = lambda df: (df.join(by_lang, "_lang", "left").withColumn(
        "_score", (-F.col("_ll") + F.lit(shrink) * F.coalesce("median", F.lit(all_median))) / (F.col("_n") + F.lit(shrink))))
    high = lambda x: F.percentile_approx(x, quantile, 100000)
    beyond = F.col("_score") - F.coalesce("median", F.lit(all_median))
    top_all, beyond_all = drawn(known).agg(high("_score"), high(beyond)).first()
    tops = drawn(known).groupBy("_lang").agg(high("_score").alias("own"))
    own = F.col("docs") * F.lit(1 - quantile) >= F.lit(1 - 1e-9)       # else the quantile is the language's largest value
    tops = medians.join(tops, "_lang").select(
        "_lang", "median", F.when(own, F.col("own")).otherwise(F.col("median") + F.lit(beyond_all).cast("double")).alias("top"))
    usual, n_good = good.agg(F.percentile_approx(F.col("_fresh") / F.col("_n"), 0.5, 10000), F.count(F.lit(1))).first()
    freshness = (F.col("_fresh") + F.lit(shrink) * F.lit(usual)) / (F.col("_n") + F.lit(shrink))
    least = F.percentile_approx("_share", low, 100000)
    shares = good.withColumn("_share", freshness)
    floor_all = shares.agg(least).first()[0] if n_good >= min_trusted else None
    floors = (shares.filter(F.col("_lang").isNotNull()).groupBy("_lang").agg(least.alias("floor"), F.count(F.lit(1)).alias("docs"))
              .filter(F.col("docs") * F.lit(low) >= F.lit(1 - 1e-9)).drop("docs"))
    level = lambda q, m: q + F.lit(slack) * (q - m)
    limits = tops.select("_lang", level(F.col("top"), F.col("median")).alias("top")).join(floors, "_lang", "full")
    limits = broadcast_if_small(materialize(limits), row_bytes=64)
    out = drawn(scored).join(limits, "_lang", "left")
    threshold = F.coalesce("top", level(F.lit(top_all).cast("double"), F.lit(all_median).cast("double")))
    out = out.withColumns({"threshold": threshold, "freshness": freshness.cast("double"),
                           "floor": F.coalesce("floor", F.lit(floor_all).cast("double"))})
    return out.select(F.col("_id").alias(id_col), F.col("_lang").alias(lang_col), F.col("_n").alias("n_tokens"),
                      F.exp("_mean").alias("perplexity"), F.col("_score").alias("score"), "threshold", "freshness", "floor",
                      (F.coalesce(F.col("_score") <= F.col("threshold"), F.lit(True))
                       & F.coalesce(F.col("freshness") >= F.col("floor"), F.lit(True))).alias("kept"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels.filter("quality = 1").select("doc_id"))
