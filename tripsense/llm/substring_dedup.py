"""Substring deduplication by recompression.

A document is a string of words. Recompression replaces runs of a word, then, for ``ROUNDS``
rounds, pairs of neighbours (a left symbol before a right one; a symbol's side in a round is a
bit of its name) by new symbols. A symbol's name is a 64-bit hash of what it stands for, so all
tasks name equal runs and pairs alike, and equal substrings get equal interior symbols: for
every symbol the words that determine it are tracked, and any other place with the same words
has the same symbol.

1. Blocks send the names of their symbols to the shards; a shard answers which are shared.
2. A window of ``window`` words can only repeat if every symbol determined inside it is shared.
   Such candidate windows (and those that hold no symbol) go to the shards with two hashes that share neither the hash
   of a word nor the multiplier (64 and 32 bits), and with the first document that has them; a shard answers which blocks do
   not have the first one, by both hashes.
3. Blocks remove every word covered by a window that starts earlier elsewhere; it must match in both hashes.

The texts are shuffled once; all steps read that exchange. Windows are judged on the input.

Defined results: NULL text has no words; rows are documents of their own even if they share an
id (then ordered by block and text); NULL ids come last; ids are integers; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.llm.blocks import by_block, dealt, member_of, packed, shard_rows, unpacked
from tripsense.llm.segments import SegmentHasher, Words, mix64, slices

WINDOW = 20
ROUNDS = 4
_LAST = np.int64(2**63 - 1)
_NAME_BYTES = 6
#: multipliers of the two window hashes
_FACTORS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
_SALTS = mix64(np.arange(64, dtype=np.uint64))


class Block:
    """The words of a block's documents, ordered by id, then by text."""

    def __init__(self, table):
        ids = table.column("_id").to_pylist()
        texts = [t.encode("utf-8", "surrogatepass") for t in table.column("_text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids = [ids[k] for k in order]
        self.texts = [texts[k] for k in order]
        hashers, hashes, counts = [SegmentHasher(1), SegmentHasher(2)], ([], []), [np.zeros(0, np.int64)]
        for a, b in slices(self.texts):
            words = Words(self.texts[a:b])
            hashes[0].append(words.hashes(hashers[0]))
            hashes[1].append((words.hashes(hashers[1]) >> np.uint64(32)).astype(np.uint32))
            counts.append(words.counts)
        #: hashes of the words, and others that do not depend on them
        self.words = np.concatenate([np.zeros(0, np.uint64), *hashes[0]])
        self.again = np.concatenate([np.zeros(0, np.uint32), *hashes[1]])
        counts = np.concatenate(counts)
        #: words of document k: first[k] to first[k + 1]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.order = np.array([_LAST if i is None else i for i in self.ids], np.int64)

    def symbols(self, rounds: int):
        """Names of the last round's symbols and the range of words that determines each."""
        n = len(self.words)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        name, doc = self.words, self.doc
        start = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])   # runs of a word
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, n))
        name, doc = name[at], doc[at]
        name = np.where(length > 1, mix64(name * _A + length.astype(np.uint64)), name)
        lo, hi = at - 1, at + length + 1                  # both neighbours differ
        begin, end = self.first[:-1], self.first[1:]
        for r in range(1, rounds + 1):
            right = (mix64(name + _SALTS[r % 64]) >> np.uint64(63)).astype(bool)
            same = doc[1:] == doc[:-1]
            pair = np.append(~right[:-1] & right[1:] & same, False)          # with the next symbol
            taken = np.concatenate([[False], pair[:-1]])
            alone = ~pair & ~taken
            # a left symbol stays because of its next one, a right symbol because of the one before
            k = np.flatnonzero(alone & ~right)
            has = np.append(same, False)[k]
            nxt = np.minimum(k + 1, len(name) - 1)
            new_hi = np.maximum(hi[k], np.where(has, hi[nxt], end[doc[k]] + 1))
            j = np.flatnonzero(alone & right)
            has = np.concatenate([[False], same])[j]
            new_lo = np.minimum(lo[j], np.where(has, lo[np.maximum(j - 1, 0)], begin[doc[j]] - 1))
            lo, hi = lo.copy(), hi.copy()
            p = np.flatnonzero(pair)
            merged = mix64(name[p] * _A + name[p + 1] * _B + np.uint64(r))
            low, high = np.minimum(lo[p], lo[p + 1]), np.maximum(hi[p], hi[p + 1])
            hi[k], lo[j] = new_hi, new_lo
            name = name.copy()
            name[p], lo[p], hi[p] = merged, low, high
            stay = ~taken
            name, doc, lo, hi = name[stay], doc[stay], lo[stay], hi[stay]
        inside = (lo >= begin[doc]) & (hi <= end[doc])
        return name[inside], lo[inside], hi[inside]

    def window_starts(self, window: int) -> np.ndarray:
        """Which words start a window inside their document."""
        n = len(self.words)
        return np.arange(n) + window <= self.first[1:][self.doc] if n else np.zeros(0, bool)

    def window_hash(self, starts: np.ndarray, window: int) -> np.ndarray:
        """64-bit hashes of the windows at ``starts``."""
        return _polynomial(self.words, starts, window, _FACTORS[0])

    def window_check(self, starts: np.ndarray, window: int) -> np.ndarray:
        """Independent 32-bit hashes of the windows at ``starts``."""
        return _polynomial(self.again, starts, window, _FACTORS[1]) >> np.uint64(32)


def _polynomial(words: np.ndarray, starts: np.ndarray, window: int, factor: np.uint64) -> np.ndarray:
    out = np.ones(len(starts), np.uint64)
    for k in range(window):
        out *= factor
        out += words[starts + k]
    return mix64(out)


def _place(h: np.ndarray, g: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The place of each pair ``(h, g)`` among the sorted pairs ``(keys, checks)``, or -1."""
    out = np.full(len(h), -1)
    maybe = np.flatnonzero(member_of(h, keys))
    at = np.searchsorted(keys, h[maybe])
    while len(maybe):                                     # another round only where first hashes collide
        same = checks[at] == g[maybe]
        out[maybe[same]] = at[same]
        maybe, at = maybe[~same], at[~same] + 1
        more = at < len(keys)
        more[more] = keys[at[more]] == h[maybe[more]]
        maybe, at = maybe[more], at[more]
    return out


def _names(values: np.ndarray) -> np.ndarray:
    return values >> np.uint64(64 - 8 * _NAME_BYTES)


def _symbols_of(shards: int, window: int, rounds: int):
    def run(key, table):
        import pyarrow as pa

        name, lo, hi = Block(table).symbols(rounds)
        name = _names(name[hi - lo <= window])
        name.sort()
        new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
        many = np.diff(np.append(np.flatnonzero(new), len(name))) > 1
        name = name[new]
        rows = [(s, key[0].as_py(), packed(name[k], _NAME_BYTES), np.packbits(many[k]).tobytes()) for s, k in shard_rows(name, shards)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _types(pa))], _ROWS)
    return run


_ROWS = ["shard", "block", "keys", "more"]
_ROWS_SCHEMA = "shard int, block int, keys binary, more binary"


def _types(pa):
    return [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _answers(pa, block: np.ndarray, keep: np.ndarray, keys: np.ndarray, width: int, more=lambda at: None):
    """Per block the kept keys, sorted, and what ``more`` has for them."""
    at = np.flatnonzero(keep)
    at = at[np.lexsort((keys[at], block[at]))]
    blocks, first = np.unique(block[at], return_index=True)
    rows = [(0, int(b), packed(keys[p], width), more(p))
            for b, p in zip(blocks, np.split(at, first[1:]))] if len(at) else []
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _types(pa))], _ROWS)


def _shared(table):
    """Names that two blocks have, or one block several times."""
    import pyarrow as pa

    keys = [unpacked(x, _NAME_BYTES) for x in table.column("keys").to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(table.column("more").to_pylist(), keys)]
    block = np.repeat(table.column("block").to_numpy(), [len(k) for k in keys])
    keys, many = np.concatenate(keys), np.concatenate(many)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    shared = np.zeros(len(s), bool)
    shared[order] = twin
    return _answers(pa, block, shared | many, keys, _NAME_BYTES)


def _keys_of(table, width: int) -> np.ndarray:
    parts = [unpacked(x, width) for x in table.column("keys").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _windows_of(shards: int, window: int, rounds: int):
    def run(key, left, right):
        import pyarrow as pa

        block = Block(left)
        name, lo, hi = block.symbols(rounds)
        short = hi - lo <= window
        name, lo, hi = _names(name[short]), lo[short], hi[short]
        alone = ~member_of(name, _keys_of(right, _NAME_BYTES))
        lo, hi = lo[alone], hi[alone]
        n = len(block.words)
        doc = block.doc[lo] if n else lo                  # windows that hold such a symbol do not repeat
        a = np.maximum(block.first[doc], hi - window)
        out = np.cumsum(np.bincount(a, minlength=n + 2) - np.bincount(lo + 1, minlength=n + 2))[:n]
        at = np.flatnonzero((out == 0) & block.window_starts(window))
        h, g = block.window_hash(at, window), block.window_check(at, window)
        order = np.lexsort((g, h))                        # stable: the first of equal windows is the earliest
        h, g, at = h[order], g[order], at[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
        f = np.flatnonzero(new)
        many = np.diff(np.append(f, len(h))) > 1
        h, g, owner = h[f], g[f], block.order[block.doc[at[f]]]
        rows = [(s, key[0].as_py(), packed(h[k], 8), packed(g[k], 4) + packed(owner[k].view(np.uint64), 8) + many[k].astype(np.uint8).tobytes())
                for s, k in shard_rows(h, shards)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _types(pa))], _ROWS)
    return run


def _firsts(table):
    """Per block the windows that start earlier elsewhere (1), or of which only the block's first stays (2)."""
    import pyarrow as pa

    keys = [unpacked(x, 8) for x in table.column("keys").to_pylist()]
    more = table.column("more").to_pylist()
    part = lambda a, b, w: np.concatenate([unpacked(m[a * len(k):b * len(k)], w) for m, k in zip(more, keys)])
    g, owner, many = part(0, 4, 4), part(4, 12, 8).view(np.int64), part(12, 13, 1) > 0
    block = np.repeat(table.column("block").to_numpy(), [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.lexsort((block, owner, g, keys))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (g[order][1:] != g[order][:-1])])
    first = np.zeros(len(keys), bool)
    first[order] = new
    code = np.where(first, 2, 1).astype(np.uint8)
    return _answers(pa, block, ~first | many, keys, 8, lambda at: packed(g[at], 4) + code[at].tobytes())


def _removed_of(window: int):
    def run(left, right):
        import pyarrow as pa

        block = Block(left)
        parts = [(len(k) // 8, k, m) for k, m in zip(right.column("keys").to_pylist(), right.column("more").to_pylist())]
        keys = np.concatenate([np.zeros(0, np.uint64), *[unpacked(k, 8) for _, k, _ in parts]])
        checks = np.concatenate([np.zeros(0, np.uint64), *[unpacked(m[:4 * n], 4) for n, _, m in parts]])
        code = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(m, np.uint8, offset=4 * n) for n, _, m in parts]])
        order = np.lexsort((checks, keys))
        keys, checks, code = keys[order], checks[order], code[order]
        at = np.flatnonzero(block.window_starts(window))
        n = len(block.words)
        cover = np.zeros(n + 1, np.int64)
        if len(keys) and len(at):
            at = at[member_of(block.window_hash(at, window), keys)]
            place = _place(block.window_hash(at, window), block.window_check(at, window), keys, checks)
            at, place = at[place >= 0], place[place >= 0]
            one = code[place] == 1
            own = np.flatnonzero(~one)                    # of these the first in the block stays
            again = np.ones(len(own), bool)
            again[np.unique(place[own], return_index=True)[1]] = False
            gone = np.sort(np.concatenate([at[one], at[own[again]]]))
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
        removed = np.cumsum(cover)[:n] > 0
        lost = np.concatenate([[0], np.cumsum(removed)])[block.first]
        texts = []
        for k, text in enumerate(block.texts):
            words = text.split()
            if lost[k] != lost[k + 1]:
                gone = removed[block.first[k]:block.first[k + 1]].tolist()
                words = [w for w, g in zip(words, gone) if not g]
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.table({"_id": pa.array(block.ids, pa.int64()), "n_words": pa.array(np.diff(block.first), pa.int64()),
                         "n_removed": pa.array(np.diff(lost), pa.int64()), "kept_text": pa.array(texts, pa.string())})
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space)."""
    blocks, n = by_block(docs, id_col, text_col)
    names = blocks.groupBy("block").applyInArrow(_symbols_of(n, window, rounds), _ROWS_SCHEMA)
    shared = dealt(names, n, "shard").groupBy("shard").applyInArrow(_shared, _ROWS_SCHEMA)
    windows = blocks.groupBy("block").cogroup(dealt(shared, n, "block").groupBy("block")).applyInArrow(
        _windows_of(n, window, rounds), _ROWS_SCHEMA)
    firsts = dealt(windows, n, "shard").groupBy("shard").applyInArrow(_firsts, _ROWS_SCHEMA)
    out = blocks.groupBy("block").cogroup(dealt(firsts, n, "block").groupBy("block")).applyInArrow(
        _removed_of(window), "_id bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.withColumnRenamed("_id", id_col)


def op10(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
wins AS (SELECT doc_id, p, md5(string_agg(v, ' ') OVER f) AS h, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
again AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS later FROM wins WHERE n = 20),
marked AS (SELECT words.doc_id, words.p, v, coalesce(bool_or(later) OVER (
    PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words LEFT JOIN again ON words.doc_id = again.doc_id AND words.p = again.p),
per AS (SELECT doc_id, count(*) FILTER (gone) AS lost, string_agg(v, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""
