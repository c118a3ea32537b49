"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct ``SHINGLE``-word shingles. Equal sets are
collapsed first; the rest runs on one representative each.

1. Stars: representatives that share one of their ``SKETCH`` smallest tokens are compared with the
   one among them whose sketch tokens are most common. Those that link take it as their root, so a
   large group of near copies does not meet itself again.
2. Token classes: a token is frequent if ``FREQUENT`` roots or more have it. All sets are ordered
   alike: rare tokens first, then frequent ones, by hash inside.
3. Prefixes: two sets that reach the threshold share their first ``k`` common tokens within their
   first ``n - overlap + k`` tokens (``k`` is a twelfth of the smaller set, two at least). In such
   extended prefixes rare tokens are indexed singly and frequent tokens by pairs: the first common
   tokens are rare, or the first two are a pair of frequent ones. An entry carries the largest
   partner that its position in the order still allows.
4. Index entries of different roots that allow each other meet and are counted; if the prefix
   of one of the sets has no frequent token, fewer than ``k`` common tokens rule the pair out.
5. Verification: the left set is sent to the block of the right one and the sets are intersected.

The components of all links follow by large-star and small-star steps. The texts are shuffled once
(by id); the steps 1 to 5 read that exchange. No pairs inside a group of copies are written out.

Defined results: NULL text and text without words give the empty set, linked with nothing; fewer words
than a shingle are one token; rows without an id have no component; ids are integers, and rows that
share an id are one document in the components (its sets are the sets of all its rows, the first
one in text order standing for it as a representative); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.llm.blocks import dealt, member_of, packed, packed_blocks, packed_sorted, shard_rows, unpack, unpacked, unpacked_sorted
from tripsense.llm.common import shuffle_partitions, text_or_empty
from tripsense.llm.components import components
from tripsense.llm.segments import SegmentHasher, Words, mix64, ranges, slices, window_hashes
from tripsense.session import materialize

SHINGLE = 5
PERCENT = 75
SKETCH = 8
FREQUENT = 32
_NAME_BYTES = 6
_PAIRS_AT_ONCE = 2_000_000
_LARGE = 16   # entries of one root under one key that are met as a whole


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text (A-Z lower-cased, words split at ASCII white space)."""
    hasher, out = SegmentHasher(), []
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in slices(raw):
        words = Words(raw[a:b], lower=True)
        h = words.hashes(hasher)
        win = window_hashes(h, size)
        for f, l in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if l - f >= size:
                s = np.sort(win[f:l - size + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif l > f:
                out.append(mix64(window_hashes(h[f:l], l - f) + np.uint64(l - f)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of ``n`` shares with any set it links to, at least."""
    return -(-percent * n // 100)


def _least_common(n: int) -> int:
    return max(2, -(-n // 12))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_of(col: str, n: int):
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _info(size: int, sketch: int):
    def run(stream):
        import pyarrow as pa

        for batch in stream:
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            prints = [b"%d:%d:%d" % (len(s), int(s.sum()), int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum())) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()),
                 pa.array([s[:sketch].view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))],
                ["_id", "n", "print", "keys"])
    return run


def _sets_of(table, wanted: set, size: int) -> dict[int, np.ndarray]:
    """Sets of the wanted documents of a block (the first row of an id in text order)."""
    rows: dict[int, str] = {}
    for i, t in zip(*unpack(table, 2)):
        if i in wanted and (i not in rows or t < rows[i]):
            rows[i] = t
    return dict(zip(rows, shingle_sets(list(rows.values()), size)))


def _send_sets(size: int):
    def run(left, right):
        import pyarrow as pa

        ids, targets = right.column("id").to_pylist(), right.column("target").to_pylist()
        sets = _sets_of(left, set(ids), size)
        keep = [(t, i) for t, i in zip(targets, ids) if i in sets]
        return pa.table({"block": pa.array([t for t, _ in keep], pa.int32()), "a": pa.array([i for _, i in keep], pa.int64()),
                         "b": pa.nulls(len(keep), pa.int64()), "tokens": pa.array([packed(sets[i], 8) for _, i in keep], pa.binary())})
    return run


def _verify(size: int, percent: int):
    def run(left, right):
        import pyarrow as pa

        a, b, tokens = (right.column(c).to_pylist() for c in ("a", "b", "tokens"))
        sent = {i: unpacked(t, 8) for i, t in zip(a, tokens) if t is not None}
        pairs = [(x, y) for x, y in zip(a, b) if y is not None]
        own = _sets_of(left, {y for _, y in pairs}, size)
        good = [(x, y) for x, y in pairs if x in sent and y in own and linked(sent[x], own[y], percent)]
        return pa.table({"a": pa.array([x for x, _ in good], pa.int64()), "b": pa.array([y for _, y in good], pa.int64())})
    return run


def _verified(blocks: DataFrame, n: int, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets link."""
    routed = pairs.select("a", "b", _block_of("a", n).alias("from"), _block_of("b", n).alias("block"))
    need = routed.select(F.col("from").alias("block"), F.col("a").alias("id"), F.col("block").alias("target")).distinct()
    sets = blocks.groupBy("block").cogroup(dealt(need, n, "block").groupBy("block")).applyInArrow(
        _send_sets(size), "block int, a bigint, b bigint, tokens binary")
    asked = routed.select("block", "a", "b", F.lit(None).cast("binary").alias("tokens"))
    return blocks.groupBy("block").cogroup(dealt(sets.unionByName(asked), n, "block").groupBy("block")).applyInArrow(
        _verify(size, percent), "a bigint, b bigint")


_ROWS_SCHEMA = "shard int, block int, keys binary, more binary"


def _table(pa, rows):
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["shard", "block", "keys", "more"])


def _names(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(64 - 8 * _NAME_BYTES)


def _count_tokens(shards: int, size: int, bits: int):
    """Distinct tokens (by their first ``bits`` bits) of a block's representatives and how many roots have each."""
    def run(key, left, right):
        import pyarrow as pa

        root = dict(zip(right.column("node").to_pylist(), right.column("root").to_pylist()))
        sets = _sets_of(left, set(root), size)
        name = np.concatenate([np.zeros(0, np.uint64), *sets.values()]) >> np.uint64(64 - bits)
        is_root = np.repeat(np.array([root[i] == i for i in sets], np.int64), [len(x) for x in sets.values()])
        name, at = np.unique(name, return_inverse=True)
        count = np.minimum(np.bincount(at, weights=is_root, minlength=len(name)), 255).astype(np.uint8)
        return _table(pa, [(s, key[0].as_py(), packed_sorted(name[k] // np.uint64(shards)), count[k].tobytes())
                           for s, k in shard_rows(name, shards)])
    return run


def _frequent(limit: int, shards: int):
    """Per block its tokens that ``limit`` roots or more have (a block's count of 255 is enough by itself)."""
    def run(key, table):
        import pyarrow as pa

        keys = [unpacked_sorted(x) for x in table.column("keys").to_pylist()]
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("more").to_pylist()]).astype(np.int64)
        blocks = table.column("block").to_pylist()
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        often = (np.bincount(inverse, weights=count) >= limit)[inverse]
        rows, at = [], 0
        for block, k in zip(blocks, keys):
            if often[at:at + len(k)].any():
                name = k[often[at:at + len(k)]] * np.uint64(shards) + np.uint64(key[0].as_py())
                rows.append((0, block, packed(name, 8), None))
            at += len(k)
        return _table(pa, rows)
    return run


def _width(*values: np.ndarray) -> int:
    return max([1, *((int(v.max()).bit_length() + 7) // 8 for v in values if len(v))])


def _largest_partner(n: int, left: np.ndarray, percent: int) -> np.ndarray:
    """The size of the largest set that a set of ``n`` can link to if they have at most ``left`` tokens in common."""
    return np.minimum((100 + percent) * left // percent - n, 100 * n // percent)


def _index(shards: int, size: int, percent: int, bits: int):
    """Index entries of a block: keys (rare tokens and pairs of frequent ones) with document, root and sizes."""
    def run(key, left, right):
        import pyarrow as pa

        nodes, roots, keys = (right.column(c).to_pylist() for c in ("node", "root", "keys"))
        root = {i: r for i, r in zip(nodes, roots) if i is not None}
        often = np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpacked(x, 8) for x in keys if x is not None]]))
        found = ([], [])                                   # of rare tokens, of pairs of frequent ones
        for doc, tokens in _sets_of(left, set(root), size).items():
            n, k = len(tokens), _least_common(len(tokens))
            frequent = member_of(tokens >> np.uint64(64 - bits), often)
            rare, rest = tokens[~frequent], tokens[frequent]
            free = n - needed_overlap(n, percent)          # tokens that it may have alone
            rare_k = rare[:min(n, free + k)]
            pure = len(rare) >= min(n, free + k)
            limit = _largest_partner(n, n - np.arange(len(rare_k)) + k - 1, percent)
            found[0].append((_names(rare_k), doc, n, limit, pure))
            rest = rest[:max(0, free + 2 - len(rare))]
            if len(rest) > 1:
                i, j = np.triu_indices(len(rest), 1)
                limit = _largest_partner(n, n - (len(rare) + j) + 1, percent)
                use = limit >= needed_overlap(n, percent)
                i, j = i[use], j[use]
                name = _names(mix64(rest[i] * np.uint64(0xC2B2AE3D27D4EB4F) + rest[j]))
                found[1].append((name, doc, n, limit[use], pure))
        rows = []
        for kind, parts in enumerate(found):
            if not parts:
                continue
            per = [len(x[0]) for x in parts]
            name, limit = np.concatenate([x[0] for x in parts]), np.concatenate([x[3] for x in parts])
            doc, top, n, pure = (np.repeat(np.array(v), per) for v in (
                [x[1] for x in parts], [root[x[1]] for x in parts], [x[2] for x in parts], [x[4] for x in parts]))
            for s, k in shard_rows(name, shards):
                d, t, m, lim = (v[k].astype(np.int64).view(np.uint64) for v in (doc, top, n, limit))
                other = d != t
                w, v = _width(d, t), _width(m, lim)
                more = (bytes([kind, w, v]) + packed(d, w) + packed(m, v) + packed(lim, v) + np.packbits(pure[k]).tobytes()
                        + np.packbits(other).tobytes() + packed(t[other], w))
                rows.append((s, key[0].as_py(), packed(name[k], _NAME_BYTES), more))
        return _table(pa, rows)
    return run


def _entries(table, kind: int):
    """Names, documents, roots, sizes, largest partners and purity of the entries of a kind."""
    out = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, bool)]
    for x, m in zip(table.column("keys").to_pylist(), table.column("more").to_pylist()):
        if m[0] != kind:
            continue
        n, w, v, at = len(x) // _NAME_BYTES, m[1], m[2], 3
        def take(count, width):
            nonlocal at
            at += count * width
            return m[at - count * width:at]
        d, size, limit = unpacked(take(n, w), w), unpacked(take(n, v), v), unpacked(take(n, v), v)
        pure, other = (np.unpackbits(np.frombuffer(take((n + 7) // 8, 1), np.uint8), count=n).astype(bool) for _ in range(2))
        r = d.copy()
        r[other] = unpacked(m[at:], w)
        for own, more in zip(out, (unpacked(x, _NAME_BYTES), d, r, size.view(np.int64), limit.view(np.int64), pure)):
            own.append(more)
    return [np.concatenate(x) for x in out]


def _meetings(name, root, n, limit, percent: int):
    """Index pairs of entries of one key and different roots whose sizes allow each other, part by part.

    Entries of a root that has many under a key are met by the other roots' entries as one range, so a large
    group of near copies is never paired with itself.
    """
    order = np.lexsort((n, root, name))
    name, root, n, limit = name[order], root[order], n[order], limit[order]
    key_new = np.concatenate([[True], name[1:] != name[:-1]])
    seg_new = key_new | np.concatenate([[True], root[1:] != root[:-1]])
    key_no, seg_no = np.cumsum(key_new) - 1, np.cumsum(seg_new) - 1
    seg_at = np.append(np.flatnonzero(seg_new), len(name))
    several = np.bincount(key_no[seg_at[:-1]])[key_no] > 1
    large = np.diff(seg_at)[seg_no] >= _LARGE

    def ranged(x, first, last, place=None):
        count = np.maximum(last - first, 0)
        upto = np.cumsum(count)
        cuts = np.searchsorted(upto, np.arange(_PAIRS_AT_ONCE, upto[-1] if len(upto) else 0, _PAIRS_AT_ONCE))
        for part in np.split(np.arange(len(x)), np.unique(cuts)):
            a, b = np.repeat(x[part], count[part]), ranges(first[part], count[part])
            b = b if place is None else place[b]
            good = (root[a] != root[b]) & (limit[a] >= n[b]) & (limit[b] >= n[a])
            if good.any():
                yield order[a[good]], order[b[good]]

    small = np.flatnonzero(several & ~large)
    small = small[np.lexsort((n[small], key_no[small]))]
    wide = int(max(n.max(), limit.max())) + 1
    place = key_no[small] * wide + n[small]
    last = np.searchsorted(place, key_no[small] * wide + np.minimum(limit[small], wide - 1), side="right")
    yield from ranged(small, np.arange(len(small)) + 1, last, small)
    key_at = np.append(np.flatnonzero(key_new), len(name))
    for s in np.unique(seg_no[several & large]).tolist():
        a, b = seg_at[s], seg_at[s + 1]
        k = key_no[a]
        before = np.arange(key_at[k], a)
        x = np.concatenate([before[~large[before]], np.arange(b, key_at[k + 1])])
        first = a + np.searchsorted(n[a:b], -(-percent * n[x] // 100))
        yield from ranged(x, first, a + np.searchsorted(n[a:b], limit[x], side="right"))


def _meet(percent: int):
    """Pairs of documents that meet, how many rare tokens they meet under, and whether these must be ``k``."""
    def run(table):
        import pyarrow as pa

        lows, highs, counts, strict = [], [], [], []
        for kind in (0, 1):
            name, doc, root, n, limit, pure = _entries(table, kind)
            if not len(name):
                continue
            for x, y in _meetings(name, root, n, limit, percent):
                lo, hi, sure = np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), pure[x] | pure[y]
                order = np.lexsort((hi, lo))
                lo, hi, sure = lo[order], hi[order], sure[order]
                new = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
                lows.append(lo[new])
                highs.append(hi[new])
                counts.append(np.diff(np.append(new, len(lo))) if kind == 0 else np.zeros(len(new), np.int64))
                strict.append(sure[new] & (kind == 0))
        cat = lambda xs, t: np.concatenate(xs).view(t) if xs else np.zeros(0, t)
        return pa.table({"a": pa.array(cat(lows, np.int64)), "b": pa.array(cat(highs, np.int64)),
                         "common": pa.array(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)),
                         "strict": pa.array(cat(strict, bool))})
    return run


def links(docs: DataFrame, reps: DataFrame, stars: DataFrame, id_col: str, text_col: str, size: int, percent: int,
          frequent: int) -> DataFrame:
    """Verified links ``(a, b)`` between representatives ``reps (node, n)``; ``stars (a, b)``: first pairs to compare."""
    n = shuffle_partitions(docs)
    tokens = reps.agg(F.sum("n")).first()[0] or 1
    bits = min(62, max(16, int(tokens).bit_length() + 5))  # chance meetings of token names stay rare at every size
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
    blocks = packed_blocks(rows.select(_block_of("_id", n).alias("block"), "_id", "_text"), n)
    near = _verified(blocks, n, stars, size, percent).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    rooted = dealt(reps.join(near, "node", "left")
                   .select(_block_of("node", n).alias("block"), "node", F.coalesce("root", "node").alias("root")), n, "block")
    counts = blocks.groupBy("block").cogroup(rooted.groupBy("block")).applyInArrow(_count_tokens(n, size, bits), _ROWS_SCHEMA)
    often = dealt(counts, n, "shard").groupBy("shard").applyInArrow(_frequent(frequent, n), _ROWS_SCHEMA)
    known = rooted.select("block", "node", "root", F.lit(None).cast("binary").alias("keys")).unionByName(
        often.select("block", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("root"), "keys"))
    index = blocks.groupBy("block").cogroup(dealt(known, n, "block").groupBy("block")).applyInArrow(_index(n, size, percent, bits), _ROWS_SCHEMA)
    met = (dealt(index, n, "shard").groupBy("shard").applyInArrow(_meet(percent), "a bigint, b bigint, common bigint, strict boolean")
           .groupBy("a", "b").agg(F.sum("common").alias("common"), F.bool_or("strict").alias("strict")))
    sizes = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    k = F.greatest(F.lit(2), F.ceil(F.least("n_a", "n_b") / 12))
    pairs = (met.join(sizes("a"), "a").join(sizes("b"), "b").filter(~F.col("strict") | (F.col("common") >= k)).select("a", "b"))
    verified = _verified(blocks, n, pairs, size, percent)
    return verified.unionByName(rooted.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                       percent: int = PERCENT, sketch: int = SKETCH, frequent: int = FREQUENT) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id`` (the smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
    info = materialize(rows.mapInArrow(_info(size, sketch), "_id bigint, n bigint, print binary, keys array<bigint>"))
    reps = materialize(info.filter("n > 0 AND _id IS NOT NULL").groupBy("print", "n")
                       .agg(F.min("_id").alias("node"), F.first("keys").alias("keys")))
    by_key = reps.select("node", "n", F.explode("keys").alias("key"))
    # tables of keys are stored before they are joined: a join of two plain exchanges is one that Spark splits where a key
    # is hot, which it can't where an aggregate holds the rows of a key together
    shared = materialize(by_key.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    by_key = by_key.join(shared, "key")
    known = materialize(by_key.join(by_key.groupBy("node").agg(F.sum("c").alias("weight")), "node"))
    pivots = materialize(known.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("first"), "n")).alias("top")))
    stars = (known.join(pivots.select("key", (-F.col("top.first")).alias("a"), F.col("top.n").alias("m")), "key")
             .filter(F.col("a") != F.col("node"))
             .filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
             .select("a", F.col("node").alias("b")).distinct())
    found = materialize(links(docs, reps.select("node", "n"), materialize(stars), id_col, text_col, size, percent, frequent))
    roots = components(found)
    nodes = reps.select("print", "n", "node").join(roots, "node", "left").select(
        "print", "n", F.coalesce("root", "node").alias("component_id"))
    joined = info.select("_id", "n", "print").join(nodes, ["print", "n"], "left")
    return joined.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                         F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"))


def op4(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
runs AS (SELECT doc_id, n, p, md5(string_agg(v, ' ') OVER f) AS s, count(*) OVER f AS c FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, s FROM runs WHERE c = 5 OR (n < 5 AND p = 1)),
sizes AS (SELECT doc_id, count(*) AS size FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 75 * (a.size + b.size - common)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM ways UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
roots AS (SELECT x AS doc_id, min(y) AS root FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN roots ON roots.doc_id = d.doc_id"""
