"""Documents in blocks, and key lists exchanged between blocks and shards.

A block is a hash-bucket of whole documents that one task holds in arrays; a shard is a
hash-bucket of keys. Blocks send each shard the sorted distinct keys they hold (one packed row
per block and shard), the shard compares them and answers each block. The texts themselves are
shuffled once: every step reads the same exchange.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.llm.common import shuffle_partitions, text_or_empty
from tripsense.llm.segments import release


def dealt(rows: DataFrame, n: int, column: str) -> DataFrame:
    """``rows`` with block (or shard) ``k`` in partition ``k``: one a task, where hashing its number would put several
    into some tasks and none into others. Both sides of a cogroup must be dealt alike."""
    return rows.repartitionById(n, column)


def by_block(docs: DataFrame, id_col: str, text_col: str, *more: str) -> tuple[DataFrame, int]:
    """``block, _id, _text`` and further columns, shuffled by block, and the number of blocks."""
    n = shuffle_partitions(docs)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"), *more)
    block = F.pmod(F.xxhash64("_id", "_text"), F.lit(n)).cast("int").alias("block")
    return dealt(rows.select(block, "_id", "_text", *more), n, "block"), n


#: bytes of text that a block holds on average at least
BLOCK_BYTES = 8 << 20


def block_count(docs: DataFrame, text_col: str) -> int:
    """As many blocks as there are shuffle partitions, or fewer of ``BLOCK_BYTES`` each: small blocks would
    ask for the same keys again and again."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, min(shuffle_partitions(docs), -(-total // BLOCK_BYTES)))


def packed_blocks(rows: DataFrame, n: int) -> DataFrame:
    """``block, payload``: the rows of a task that belong to one block (first column) as one compressed
    value, shuffled by block; texts take about half of what they take as rows."""
    def pack(stream):
        import pyarrow as pa

        codec = pa.Codec("zstd", compression_level=3)
        for batch in stream:
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order])) + 1
            out = []
            for part in np.split(order, edges) if len(order) else ():
                take = pa.array(part)
                raw = pickle.dumps([c.take(take).to_pylist() for c in batch.columns[1:]], protocol=5)
                out.append((int(block[part[0]]), len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())],
                                             ["block", "payload"])

    return dealt(rows.mapInArrow(pack, "block int, payload binary"), n, "block")


def unpack(table, columns: int) -> list[list]:
    """The columns of a block's rows."""
    import pyarrow as pa

    release()
    codec, out = pa.Codec("zstd"), [[] for _ in range(columns)]
    for x in table.column("payload").to_pylist():
        raw = codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
        for own, more in zip(out, pickle.loads(raw)):
            own.extend(more)
    return out


def shard_rows(keys: np.ndarray, shards: int):
    """``(shard, positions)`` of the keys of every shard."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in range(shards):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k]:edges[k + 1]]


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values: their number, the first one, and the steps between them in as few bytes as fit."""
    step = np.diff(values)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return bytes([width]) + (values[:1].tobytes() + packed(step, width) if len(values) else b"")


def unpacked_sorted(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[1:9], np.uint64), unpacked(data[9:], data[0])]), dtype=np.uint64)


def member_of(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys (a bit table first rules most others out)."""
    out = np.zeros(len(values), bool)
    if not len(sorted_keys) or not len(values):
        return out
    bits = 22
    table = np.zeros(1 << bits, bool)
    slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table[slot(sorted_keys)] = True
    maybe = np.flatnonzero(table[slot(values)])
    at = np.minimum(np.searchsorted(sorted_keys, values[maybe]), len(sorted_keys) - 1)
    out[maybe] = sorted_keys[at] == values[maybe]
    return out


class Positions:
    """Positions of values in a sorted list of keys that has all of them."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(values)]
        wrong = np.flatnonzero(self.keys[at] != values)   # places that several keys share
        at[wrong] = np.searchsorted(self.keys, values[wrong])
        return at
