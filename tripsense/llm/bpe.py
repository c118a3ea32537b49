"""Byte-level BPE encoding and decoding over given ranks (numpy inside Arrow batches; no training).

Pre-tokenisation without regex. Every code point gets a class symbol from an array
(letter, number, other, white space by what follows it, apostrophe of a contraction);
every symbol is a function on the eight states of a small automaton. Functions compose
associatively, so a batch is cut into columns of equal length, the functions of all columns
are composed side by side, their starting states follow from a scan over the columns, and a
second pass marks the boundaries. The first character of a document is a function that
ignores the state, hence documents never influence each other.

Pair merging. Equal pre-tokens of a task are merged once (cache keyed by segment hash, with
the bytes compared). Short ones merge side by side in padded matrices, one lowest-ranked
leftmost pair a round; long ones through a heap. A pair's rank is that of the joined bytes.

Defined results: NULL text counts as empty (no tokens); whole texts of any length; special
tokens are ordinary text; repeated rows give repeated results; other columns are not read.
The rank table (at most a few MB) and the class table (1.1 MB) are broadcast: their size is
that of the vocabulary and of Unicode.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.llm.segments import SegmentHasher, ranges, release, slices

# symbols
_L, _N, _O, _Q1, _Q2, _SMID, _SPLAST, _SLAST = range(8)
# states: 0 next starts a token, 1 letters, 2 numbers, 3 others, 4 white space, 5 a space that joins
# what follows, 6 and 7 one or two letters of a contraction to come
_NEXT = np.array([
    [1, 1, 1, 1, 1, 1, 0, 6],   # letter
    [2, 2, 2, 2, 2, 2, 2, 2],   # number
    [3, 3, 3, 3, 3, 3, 3, 3],   # other
    [6, 6, 6, 3, 6, 3, 6, 6],   # apostrophe before s t m d
    [7, 7, 7, 3, 7, 3, 7, 7],   # apostrophe before re ve ll
    [4, 4, 4, 4, 4, 4, 4, 4],   # white space, more of it or the end follows
    [5, 5, 5, 5, 5, 5, 5, 5],   # space before something else
    [0, 0, 0, 0, 0, 0, 0, 0],   # other white space before something else
], np.uint8)
_STARTS = np.array([
    [1, 0, 1, 1, 1, 0, 0, 0],
    [1, 1, 0, 1, 1, 0, 1, 1],
    [1, 1, 1, 0, 1, 0, 1, 1],
    [1, 1, 1, 0, 1, 0, 1, 1],
    [1, 1, 1, 0, 1, 0, 1, 1],
    [1, 1, 1, 1, 0, 1, 1, 1],
    [1] * 8,
    [1] * 8,
], bool)
# symbols 8 to 15: the same at the first character of a document
_NEXT = np.vstack([_NEXT, np.repeat(_NEXT[:, :1], 8, axis=1)])
_STARTS = np.vstack([_STARTS, np.ones((8, 8), bool)])
_COLUMN = 256          # characters a column
_SHORT = 48            # bytes up to which pre-tokens merge in matrices
_CACHE = 500_000     # pre-tokens kept by a task
_SLICE = 1 << 20     # bytes of text encoded at once (a longer document alone)
_NONE = np.int32(2**31 - 1)


def class_table() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 white space."""
    kind = {"L": 0, "N": 1}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 2) for c in range(0x110000)), np.uint8, 0x110000)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Arrays for pair lookup and decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        words = [b""] * size
        for w, r in ranks.items():
            words[r] = w
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.shift = np.int64(size)
        pairs = {}
        for w, r in ranks.items():
            for k in range(1, len(w)):
                a, b = ranks.get(w[:k]), ranks.get(w[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[int(k)] for k in self.keys], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the joined pair; none where it is no token or a side is missing (-1)."""
        key = a.astype(np.int64) * self.shift + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.values[at], _NONE)


def boundaries(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. ``codes``: code points of several texts; ``first``: starts of non-empty texts."""
    n = len(codes)
    kind = classes[codes]
    space = kind == 3
    begins = np.zeros(n + 1, bool)
    begins[first] = begins[n] = True
    follows = np.zeros(n, bool)                       # something else than white space follows in the same text
    follows[:-1] = ~space[1:]
    follows &= ~begins[1:]
    sym = kind.copy()
    sym[space] = _SMID
    sym[space & follows] = _SLAST
    sym[space & follows & (codes == 0x20)] = _SPLAST
    quote = np.flatnonzero((codes == 0x27) & ~begins[1:])
    if len(quote):
        c1 = codes[quote + 1]
        sym[quote[np.isin(c1, [ord(c) for c in "stmd"])]] = _Q1
        two = quote[~begins[quote + 2]] if len(quote) else quote
        a, b = codes[two + 1], codes[two + 2]
        sym[two[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]] = _Q2
    sym[first] += 8
    width = -(-n // _COLUMN)
    grid = np.full(width * _COLUMN, 8, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(width, _COLUMN).T)
    table, starts = _NEXT.ravel(), _STARTS.ravel()
    step = grid.astype(np.int32) * 8
    fun = np.repeat(np.arange(8, dtype=np.uint8)[:, None], width, axis=1)   # composed function of every column
    for row in step:
        fun = table[row[None, :] + fun]
    enter, state = np.zeros(width, np.uint8), 0
    for k, f in enumerate(fun.T.tolist()):                                   # scan over the columns
        enter[k] = state
        state = f[state]
    marks = np.empty((_COLUMN, width), bool)
    for k, row in enumerate(step):
        at = row + enter
        marks[k] = starts[at]
        enter = table[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def _merge_long(vocab: Vocabulary, piece: np.ndarray) -> list[int]:
    ids = vocab.single[piece].tolist()
    n = len(ids)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    first = vocab.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
    heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(first) if r != _NONE]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def push(a: int, b: int) -> None:
        if (pair := (ids[a], ids[b])) not in known:
            known[pair] = int(vocab.rank(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
        if known[pair] != _NONE:
            heapq.heappush(heap, (known[pair], a, *pair))

    while heap:
        r, k, a, b = heapq.heappop(heap)
        j = right[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue
        ids[k], ids[j] = r, -1
        right[k] = right[j]
        if right[k] < n:
            left[right[k]] = k
            push(k, right[k])
        if left[k] >= 0:
            push(left[k], k)
    return [x for x in ids if x >= 0]


def _merge_short(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Ids of pieces of at most ``width`` bytes: a matrix, padded by -1."""
    grid = starts[:, None] + np.arange(width)
    ids = np.where(np.arange(width) < lengths[:, None], vocab.single[data[np.minimum(grid, len(data) - 1)]], -1).astype(np.int32)
    out = ids.copy()
    rows = np.arange(len(ids))
    rank = vocab.rank(ids[:, :-1], ids[:, 1:])
    col = np.arange(width)
    while len(rows):
        best = rank.argmin(axis=1)
        value = rank[np.arange(len(best)), best]
        done = value == _NONE
        if done.any():
            out[rows[done]] = ids[done]
            go = ~done
            rows, ids, rank, best, value = rows[go], ids[go], rank[go], best[go], value[go]
            if not len(rows):
                break
        k = np.arange(len(rows))
        move = col + (col > best[:, None])                # what stands right of the pair moves up by one
        ids = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)[k[:, None], move]
        ids[k, best] = value
        rank = np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE)[k[:, None], move[:, :-1]]
        rank[k, best] = vocab.rank(value, ids[k, best + 1])
        has = best > 0
        rank[k[has], best[has] - 1] = vocab.rank(ids[k[has], best[has] - 1], value[has])
    return out


def _same_bytes(a: np.ndarray, a_starts, a_lengths, b: np.ndarray, b_starts, b_lengths) -> bool:
    """Whether all segments of ``a`` equal those of ``b``."""
    return np.array_equal(a_lengths, b_lengths) and np.array_equal(a[ranges(a_starts, a_lengths)], b[ranges(b_starts, b_lengths)])


class Encoder:
    """Encodes lists of UTF-8 texts; keeps the merged pre-tokens of a task."""

    def __init__(self, vocab: Vocabulary, classes: np.ndarray):
        self.vocab, self.classes, self.hasher = vocab, classes, SegmentHasher()
        self._forget()

    def _forget(self) -> None:
        # places and lengths in 32 bits: the cache of a worker is bounded by _CACHE pre-tokens and forgotten beyond 2 GB of bytes
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        #: the bytes of the kept pre-tokens, and where and how long each is
        self.kept, self.begin, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def pieces(self, texts: list[bytes]):
        """Bytes of all texts; byte starts of pre-tokens; how many each text has."""
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        if not len(data):
            return data, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        char = (data & 0xC0) != 0x80
        where = np.flatnonzero(char)                     # byte of every character
        codes = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0] + [len(t) for t in texts])
        first = np.searchsorted(where, begin)            # character of every text
        cut = boundaries(codes, np.unique(first[:-1][np.diff(first) > 0]), self.classes)
        starts = where[cut]
        return data, starts, np.diff(np.searchsorted(starts, begin))

    def _merge(self, data, starts, lengths):
        flat, count = [], np.zeros(len(starts), np.int64)
        order = []
        low = 0
        for width in (2, 4, 8, 16, _SHORT):
            pick = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for part in np.array_split(pick, max(1, len(pick) * width // 500_000 + 1)) if len(pick) else ():
                ids = _merge_short(self.vocab, data, starts[part], lengths[part], width)
                count[part] = (ids >= 0).sum(axis=1)
                flat.append(ids[ids >= 0])
                order.append(part)
        for k in np.flatnonzero(lengths > _SHORT):
            ids = _merge_long(self.vocab, data[starts[k]:starts[k] + lengths[k]])
            count[k] = len(ids)
            flat.append(np.array(ids, np.int32))
            order.append(np.array([k]))
        where = np.zeros(len(starts), np.int64)
        if order:
            order = np.concatenate(order)
            where[order] = np.cumsum(count[order]) - count[order]
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), where, count

    def encode(self, texts: list[bytes]):
        """Ids of all texts in a row; how many each text has; the byte offset of every id in its text."""
        data, starts, per_text = self.pieces(texts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        hashes = self.hasher(data, starts, starts + lengths)
        keys, rep, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == keys[known]
        old = found[known]
        if not (_same_bytes(data, starts[rep][inverse], lengths[rep][inverse], data, starts, lengths)
                and _same_bytes(self.kept, self.begin[old].astype(np.int64), self.size[old].astype(np.int64), data, starts[rep[known]], lengths[rep[known]])):
            rep, inverse = np.arange(len(starts)), np.arange(len(starts))        # a hash collision: every piece on its own
            self._forget()
            flat, at, count = self._merge(data, starts, lengths)
        else:
            new = np.flatnonzero(~known)
            f, a, c = self._merge(data, starts[rep[new]], lengths[rep[new]])
            at, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            at[known], count[known] = self.at[old], self.count[old]
            at[new], count[new] = a + len(self.flat), c
            flat = np.concatenate([self.flat, f])
            fresh = int(lengths[rep[new]].sum())
            if len(self.keys) + len(new) > _CACHE or max(len(self.kept) + fresh, len(flat)) >= 2**31:
                self._forget()
            else:
                merged = np.concatenate([self.keys, keys[new]])
                order = np.argsort(merged, kind="stable")
                size = lengths[rep[new]]
                begin = np.cumsum(size) - size + len(self.kept)
                self.kept = np.concatenate([self.kept, data[ranges(starts[rep[new]], size)]])
                self.keys, self.flat = merged[order], flat
                for name, more in (("at", at[new]), ("count", count[new]), ("begin", begin), ("size", size)):
                    setattr(self, name, np.concatenate([getattr(self, name), more.astype(np.int32)])[order])
        n = count[inverse]
        ids = flat[ranges(at[inverse], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        edge = np.concatenate([[0], np.cumsum(per_text)])
        per = np.diff(total[edge])
        size = self.vocab.lengths[ids]
        offset = np.cumsum(size) - size
        begin = np.cumsum([0] + [len(t) for t in texts[:-1]])
        return ids, per, offset - np.repeat(begin, per)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids."""
        return self.vocab.bytes[ranges(self.vocab.offsets[ids], self.vocab.lengths[ids])]


def _run(docs: DataFrame, vocabulary_path: str, schema: str, make, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(load_ranks(vocabulary_path)), class_table()))

    def batches(stream):
        import pyarrow as pa

        release()
        encoder = Encoder(*shared.value)
        for batch in stream:
            texts = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, _SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *make(pa, encoder, texts[a:b])], names)
        del encoder
        release()

    names = [id_col, *(part.split()[0] for part in schema.split(", "))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(batches, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {schema}")


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``ids array<int>`` and ``offsets array<int>`` (byte where each token starts)."""
    def make(pa, encoder, texts):
        ids, per, offset = encoder.encode(texts)
        edge = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        return [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (ids, offset)]
    return _run(docs, vocabulary_path, "ids array<int>, offsets array<int>", make, id_col, text_col)


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``ids``, ``offsets``, the sha256 of the bytes decoded from the ids, and ``intact``: whether those are
    the bytes of the text and every offset is where its token's bytes begin."""
    def make(pa, encoder, texts):
        ids, per, offset = encoder.encode(texts)
        edge = np.concatenate([[0], np.cumsum(per)])
        size = encoder.vocab.lengths[ids]
        run = np.concatenate([[0], np.cumsum(size)])
        plain, at = encoder.decode(ids).tobytes(), run[edge].tolist()
        placed = offset + np.repeat(run[edge[:-1]], per) == run[:-1]
        wrong = np.diff(np.concatenate([[0], np.cumsum(~placed)])[edge]) > 0
        decoded = [plain[a:b] for a, b in zip(at, at[1:])]
        cuts = pa.array(edge.astype(np.int32))
        return [*(pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (ids, offset)),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                pa.array([d == t and not w for d, t, w in zip(decoded, texts, wrong)], pa.bool_())]
    return _run(docs, vocabulary_path, "ids array<int>, offsets array<int>, decoded_sha256 string, intact boolean", make, id_col, text_col)


def bpe_decode(rows: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: ``text`` from its ids (invalid UTF-8 is replaced); NULL ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(vocabulary_path)))

    def batches(stream):
        import pyarrow as pa

        words = shared.value
        for batch in stream:
            texts = [words.bytes[ranges(words.offsets[x], words.lengths[x])].tobytes().decode("utf-8", "replace")
                     for x in (np.asarray(i or (), np.int64) for i in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    part = rows.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return part.mapInArrow(batches, f"`{id_col}` {dict(rows.dtypes)[id_col]}, text string")


def bpe_digest(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_tokens``, sha256 of its ids (little-endian uint32) and of the bytes decoded from them."""
    def make(pa, encoder, texts):
        ids, per, _ = encoder.encode(texts)
        plain = encoder.decode(ids)
        size = encoder.vocab.lengths[ids]
        edge = np.concatenate([[0], np.cumsum(per)])
        at = np.concatenate([[0], np.cumsum(size)])[edge].tolist()
        raw, plain, edge = ids.astype("<u4").tobytes(), plain.tobytes(), edge.tolist()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array(per.astype(np.int64)), pa.array([sha(raw[4 * a:4 * b]) for a, b in zip(edge, edge[1:])], pa.string()),
                pa.array([sha(plain[a:b]) for a, b in zip(at, at[1:])], pa.string())]
    return _run(docs, vocabulary_path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, id_col, text_col)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8(docs: DataFrame) -> DataFrame:
    return bpe_digest(docs, default_vocabulary())
