"""Document fingerprints by spot signatures (DataFrame functions only).

A spot signature is a chain of up to ``CHAIN`` content words that follows an anchor, that is
one of the most common function words (or the start of the text) before a content word;
function words inside the chain are skipped. Where the fixed function words do not reach, that is in
stretches of ``SPARSE`` words or more without one and in texts without any, every word starts a chain.
The fingerprint of a text is the sorted set of its signatures' 32-bit hashes. Two fingerprints are compared by Jaccard likeness; :func:`near_duplicates` partitions
them by set length, so that only sets whose lengths allow the threshold meet, and prunes by
length before the sets are intersected.

:func:`with_neighbour` gives every document the next one in descending id order without a
global sort: ids are cut into blocks at their quantiles, rows are shuffled once by block, and
the first row of each block is copied to the block before it.

Defined results: NULL text counts as empty; a text without words but with characters has one
signature, its own hash; the empty text has none, and two empty sets are alike (1.0); rows of
the same id are ordered by a hash of the text, rows without an id come last; a single
document is its own neighbour; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripsense.llm.common import shuffle_partitions, text_or_empty
from tripsense.session import materialize

#: fixed values: the anchors, common function words of English, German, French and Spanish
ANCHORS = tuple(dict.fromkeys(
    "the of and to in is it was for on with as by at that this from are be or an not "
    "der die das und den von zu mit ist des auf für im dem nicht ein eine als "
    "le la les de et en un une du est que pour dans qui par sur au pas "
    "el los las y del por con para es se no su al una".split()))
CHAIN = 2
#: this many words without an anchor are a stretch where every word is one
SPARSE = 16
THRESHOLD = 0.75
_START = "^"
_ANY = "*"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _signatures_of(words: Column) -> Column:
    """Signature hashes of an array of words that begins with the start mark, one per chain.

    The words between two anchors are a gap. As content words keep their order, the ``k``-th anchor at place ``p`` is
    followed by the content word number ``p - k``.
    """
    anchor = lambda x: x.isin(_START, *ANCHORS)

    def chains(places: Column, content: Column) -> Column:
        least = F.when(F.size(places) > 1, SPARSE).otherwise(1)  # by more than the start
        sign = lambda mark, j: F.xxhash64(mark, F.get(content, j), F.get(content, j + 1)).bitwiseAND(F.lit(0xFFFFFFFF))

        def gap(place: Column, k: Column) -> Column:
            following = F.coalesce(F.get(places, k + 1), F.size(words))
            rest = following - place - 2                   # content words of the gap after the first one
            first = F.when(rest >= 0, F.array(sign(F.get(words, place), place - k))).otherwise(none)
            # each of a long stretch, if another word follows
            last = F.least(rest, F.size(words) - place - 3)
            more = F.when((rest >= least) & (last >= 1), F.transform(F.sequence(F.lit(1), last), lambda m: sign(F.lit(_ANY), place - k + m)))
            return F.concat(first, F.coalesce(more, none))

        return F.flatten(F.transform(places, gap))

    none = F.array().cast("array<bigint>")
    places = F.filter(F.transform(words, lambda x, i: F.when(anchor(x), i)), lambda i: i.isNotNull())
    return _let(places, lambda p: _let(F.filter(words, lambda x: ~anchor(x)), lambda c: chains(p, c)))


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes of a text (array of long, 32 bits each)."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    hashes = _let(F.split(F.rtrim(F.concat(F.lit(f"{_START} "), words)), " "), _signatures_of)
    alone = F.when(F.length(text) > 0, F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(
        F.array().cast("array<bigint>"))
    return _let(hashes, lambda h: F.when(F.size(h) > 0, F.sort_array(F.array_distinct(h))).otherwise(alone))


def fingerprint(signs: Column) -> Column:
    """The signature set as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(signs, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def pruned_jaccard(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without intersecting them where their lengths rule ``at_least`` out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (F.when(large == 0, F.lit(1.0))
            .when((small == 0) | (small < F.lit(at_least) * large), F.lit(0.0))
            .otherwise(both / (F.size(a) + F.size(b) - both)))


def _block(id_col: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are below the id, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    coarse = F.size(F.filter(array([g[-1] for g in groups]), lambda x: x < id_col))
    fine = F.element_at(F.array(*[array(g) for g in groups]), F.least(coarse + 1, F.lit(len(groups))))
    inside = F.size(F.filter(fine, lambda x: x < id_col))
    return F.coalesce(F.when(coarse == len(groups), F.lit(len(bounds))).otherwise(coarse * step + inside), F.lit(0))


def with_neighbour(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """``_id``, ``_text``, ``_next`` (text of the next document in descending id order) and ``_halo``.

    Rows with ``_halo`` are copies that only serve as neighbours. Also returns the window that orders a block.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    n = shuffle_partitions(docs)
    cuts = rows.agg(F.percentile_approx("_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(cuts or ()))
    rows = rows.withColumns({"_block": _block(F.col("_id"), bounds), "_hash": F.xxhash64("_text")})
    # first row of each block: one row a block
    first = {r["_block"]: r["top"] for r in rows.groupBy("_block").agg(
        F.max(F.struct("_id", F.bitwise_not("_hash").alias("h"))).alias("top")).collect()}
    blocks = sorted(first)
    before = {b: blocks[(k + 1) % len(blocks)] for k, b in enumerate(blocks)}
    id_type = dict(rows.dtypes)["_id"]

    def lookup(values: dict, kind: str) -> Column:
        full = F.array(*[F.lit(values.get(b)).cast(kind) for b in range((blocks[-1] if blocks else 0) + 1)])
        return F.element_at(full, F.col("_block") + 1)

    top = (F.col("_id").eqNullSafe(lookup({b: r[0] for b, r in first.items()}, id_type))
           & (F.bitwise_not("_hash") == lookup({b: r[1] for b, r in first.items()}, "bigint")))
    copies = F.when(top, F.array(F.struct(F.col("_block").alias("b"), F.lit(False).alias("halo")),
                                 F.struct(lookup(before, "int").alias("b"), F.lit(True).alias("halo")))
                    ).otherwise(F.array(F.struct(F.col("_block").alias("b"), F.lit(False).alias("halo"))))
    spread = rows.withColumn("_c", F.explode(copies)).select(
        "_id", "_text", "_hash", F.col("_c.b").alias("_block"), F.col("_c.halo").alias("_halo"))
    order = Window.partitionBy("_block").orderBy("_halo", F.col("_id").desc_nulls_last(), "_hash")
    return spread.withColumn("_next", F.lead("_text").over(order)), order


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``signatures``."""
    return docs.select(F.col(id_col), signatures(text_or_empty(text_col)).alias("signatures"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
                    ) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(left_id, right_id, likeness)`` of fingerprint classes (by their smallest id) with a
    likeness of ``threshold`` or more, and the membership ``(id, class_id)`` of every document.

    Set lengths are cut into partitions whose bounds grow by ``1 / threshold``: a set can only reach the
    threshold with sets of its own or the next partition. Inside, sets meet if they share one of their
    first ``n - ceil(threshold * n) + 1`` signatures.
    """
    sets = materialize(fingerprints(docs, id_col, text_col).groupBy("signatures").agg(F.min(id_col).alias("class_id")))
    members = fingerprints(docs, id_col, text_col).join(sets, "signatures").select(id_col, "class_id")
    size = F.size("signatures")
    part = F.floor(F.log(size.cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    prefix = F.slice("signatures", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    index = sets.filter(size > 0).select("class_id", part.alias("part"), F.explode(prefix).alias("sign"))
    left = index.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    met = (left.alias("a").join(index.alias("b"), (F.col("a.sign") == F.col("b.sign")) & (F.col("a.part") == F.col("b.part"))
                                & (F.col("a.class_id") != F.col("b.class_id")))
           .select(F.least("a.class_id", "b.class_id").alias("left_id"), F.greatest("a.class_id", "b.class_id").alias("right_id"))
           .distinct())
    pairs = (met.join(sets.select(F.col("class_id").alias("left_id"), F.col("signatures").alias("x")), "left_id")
             .join(sets.select(F.col("class_id").alias("right_id"), F.col("signatures").alias("y")), "right_id")
             .select("left_id", "right_id", pruned_jaccard(F.col("x"), F.col("y"), threshold).alias("likeness"))
             .filter(F.col("likeness") >= threshold))
    return pairs, members


def op9(docs: DataFrame) -> DataFrame:
    rows, order = with_neighbour(docs, "doc_id", "text")
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - half),
                      F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), half))
    signed = (rows.select("_id", "_hash", "_block", "_halo", F.length("_text").cast("long").alias("n_chars"),
                          "_text", F.when(~F.col("_halo"), edited).alias("_edited"))
              .select("_id", "_hash", "_block", "_halo", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
                      signatures(F.col("_text")).alias("_own"), signatures(F.col("_edited")).alias("_after"))
              .withColumn("_other", F.lead("_own").over(order)).filter(~F.col("_halo")))
    return signed.select(F.col("_id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"),
                         fingerprint(F.col("_after")).alias("edited_fingerprint"),
                         pruned_jaccard(F.col("_own"), F.col("_after")).alias("near_edited"),
                         pruned_jaccard(F.col("_own"), F.col("_other")).alias("near_next"))
