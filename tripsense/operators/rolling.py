"""Rolling means and standard deviations of trips in one pass over a narrow frame.

Input is a frame of key and signals only, sorted by trip and order inside each partition. A
kernel walks it in chunks of Arrow batches. For a window of W rows a trip is cut into pieces of W rows; every window is a
suffix of one piece and a prefix of the next, so mean and squared deviations of all prefixes and suffixes of all
pieces (Welford's update, side by side over the pieces) give all windows by one merge each. No sum ever spans more than
a window, whatever the trip did before, and windows of equal values have standard deviation 0 exactly. The last
``max(windows) - 1`` rows of a trip are carried into the next chunk, so memory does not grow with a trip.

What leaves a task is one row a trip (or a block of a huge trip): count, mean and squared deviations of its rolling values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.operators.keyed import block_with_halo, join_small
from tripsense.operators.trip_aggregates import TripSpec, q
from tripsense.session import materialize

#: rows a chunk has at least (a larger Arrow batch is a chunk of its own)
CHUNK_ROWS = 1 << 16
_STATS = ("ma_n", "ma_mean", "sd_n", "sd_mean", "sd_m2")


# ------------------------------------------------------------------------------------------- kernel
def _prefix_moments(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and squared deviations of all prefixes along axis 1 of ``(piece, row, signal)``."""
    mean, m2 = np.empty_like(pieces), np.empty_like(pieces)
    m = np.zeros((pieces.shape[0], pieces.shape[2]))
    s = np.zeros_like(m)
    for k in range(pieces.shape[1]):
        x = pieces[:, k]
        delta = x - m
        m = m + delta / (k + 1)
        s = s + delta * (x - m)
        mean[:, k], m2[:, k] = m, s
    return mean, m2


def rolling_moments(x: np.ndarray, begin: np.ndarray, position: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and squared deviations of the ``window`` rows that end at each row of ``x`` (rows, signals).

    ``begin``: first row of each run of rows of one trip, ``position``: place of that row in its trip. NaN where
    the window holds a NaN or does not lie in the run.
    """
    n, width = len(x), window
    length = np.diff(np.append(begin, n))
    shift = position % width                               # pieces begin at multiples of the window in the trip
    pieces = -(-(shift + length) // width)
    base = (np.cumsum(pieces) - pieces) * width + shift - begin
    at = np.arange(n) + np.repeat(base, length)
    padded = np.full((int(pieces.sum()) * width, x.shape[1]), np.nan)
    padded[at] = x
    cut = padded.reshape(-1, width, x.shape[1])
    pre_mean, pre_m2 = (a.reshape(padded.shape) for a in _prefix_moments(cut))
    suf_mean, suf_m2 = (a[:, ::-1].reshape(padded.shape) for a in _prefix_moments(cut[:, ::-1]))
    inside = np.arange(n) - np.repeat(begin, length) >= width - 1
    b = at[inside]
    a = b - (width - 1)                                    # where the window begins
    nb = b % width + 1.0
    na = width - nb
    whole = na == 0
    delta = np.where(whole[:, None], 0.0, pre_mean[b] - suf_mean[a])
    mean, m2 = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    mean[inside] = np.where(whole[:, None], pre_mean[b], suf_mean[a] + delta * (nb / width)[:, None])
    m2[inside] = np.where(whole[:, None], pre_m2[b], suf_m2[a] + pre_m2[b] + delta * delta * (na * nb / width)[:, None])
    return mean, m2


def run_moments(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of the values that are not NaN in each run, per column."""
    known = ~np.isnan(values)
    n = np.add.reduceat(known.astype(np.float64), begin, axis=0)
    total = np.add.reduceat(np.where(known, values, 0.0), begin, axis=0)
    mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
    off = np.where(known, values - np.repeat(mean, np.diff(np.append(begin, len(values))), axis=0), 0.0)
    return n, mean, np.add.reduceat(off * off, begin, axis=0)


def merge_moments(a, b):
    """Count, mean and squared deviations of two sets together."""
    (na, ma, sa), (nb, mb, sb) = a, b
    n = na + nb
    share = np.divide(nb, n, out=np.zeros_like(n), where=n > 0)
    delta = mb - ma
    return n, ma + delta * share, sa + sb + delta * delta * na * share


class RollingKernel:
    """Turns sorted chunks of rows into one row a group; ``columns``: the group's columns, then the signals."""

    def __init__(self, windows: Sequence[int], group_columns: Sequence[str], signals: Sequence[str], skip_column: str | None = None):
        self.windows, self.groups, self.signals, self.skip = tuple(windows), list(group_columns), list(signals), skip_column
        self.names = [*self.groups, *_STATS]
        self._last = None                                  # values of the open group, its statistics, its tail, rows so far

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield from self._chunk(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from self._chunk(pa.Table.from_batches(held))
        if self._last is not None:
            yield self._rows([c.slice(0, 1) for c in self._last[0]], [s[None] for s in self._last[1]])
            self._last = None

    def _rows(self, groups: list[pa.Array], stats) -> pa.RecordBatch:
        lists = []
        for s in stats:
            n, k = s.shape
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(s.ravel())))
        return pa.RecordBatch.from_arrays([*groups, *lists], self.names)

    def _chunk(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = [table[c].combine_chunks() for c in self.groups]
        begin = {0}
        for c in groups:
            begin.update((np.asarray(pc.run_end_encode(c).run_ends)[:-1]).tolist())
        begin = np.array(sorted(begin))
        x = np.column_stack([table[s].to_numpy(zero_copy_only=False).astype(np.float64) for s in self.signals])
        skip = table[self.skip].to_numpy(zero_copy_only=False).astype(bool) if self.skip else np.zeros(len(x), bool)
        position = np.zeros(len(begin), np.int64)
        more = self._last is not None and all(a[0].equals(b[0]) or not (a[0].is_valid or b[0].is_valid)
                                              for a, b in zip(self._last[0], groups))
        if self._last is not None and not more:
            yield self._rows([c.slice(0, 1) for c in self._last[0]], [s[None] for s in self._last[1]])
        first = groups
        if more:                                           # the open group goes on: its last rows come first
            tail, seen = self._last[2], self._last[3]
            x, skip = np.concatenate([tail, x]), np.concatenate([np.ones(len(tail), bool), skip])
            begin[1:] += len(tail)
            position[0] = seen - len(tail)
        ma, sd = [], []
        for w in self.windows:
            mean, m2 = rolling_moments(x, begin, position, w)
            mean[skip], m2[skip] = np.nan, np.nan
            ma.append(mean)
            sd.append(np.sqrt(np.maximum(m2, 0.0) / (w - 1)) if w > 1 else np.full_like(m2, np.nan))
        stats_ma, stats_sd = run_moments(np.hstack(ma), begin), run_moments(np.hstack(sd), begin)
        if more:
            old = self._last[1]
            for stats, was in ((stats_ma, (old[0], old[1], np.zeros_like(old[0]))), (stats_sd, old[2:])):
                for s, v in zip(stats, merge_moments(was, [s[0] for s in stats])):
                    s[0] = v
        stats = [stats_ma[0], stats_ma[1], *stats_sd]
        k, end = len(begin) - 1, len(x)
        at = begin - (len(self._last[2]) if more else 0)
        rows = pa.array(np.maximum(at, 0))
        if k:
            yield self._rows([c.take(rows.slice(0, k)) for c in first], [s[:k] for s in stats])
        keep = max(self.windows) - 1
        self._last = ([c.take(rows.slice(k, 1)) for c in first], [s[k] for s in stats],
                      x[max(begin[k], end - keep):end].copy(), int(position[k] + end - begin[k]))


# ------------------------------------------------------------------------------------------ operator
def _moments_of(rows: DataFrame, spec: TripSpec, groups: list[str], skip: str | None) -> DataFrame:
    windows, signals = spec.rolling_windows, list(spec.signals)
    schema = ", ".join([*(f"{q(g)} {dict(rows.dtypes)[g]}" for g in groups), *(f"{s} array<double>" for s in _STATS)])

    def run(batches):
        return RollingKernel(windows, groups, signals, skip)(batches)

    return rows.select(*groups, *([skip] if skip else []), *signals).mapInArrow(run, schema)


def rolling_outputs(spec: TripSpec) -> list[str]:
    out = []
    for k, (w, s) in enumerate((w, s) for w in spec.rolling_windows for s in spec.signals):
        if spec.has("rolling_mean"):
            out.append(f"CASE WHEN ma_n[{k}] > 0 THEN ma_mean[{k}] END AS {q(f'MA{w}_{s}_mean')}")
        if spec.has("rolling_std"):
            out.append(f"CASE WHEN sd_n[{k}] > 1 THEN sqrt(sd_m2[{k}] / (sd_n[{k}] - 1)) END AS {q(f'MA{w}_{s}_std')}")
    return out


def rolling_features(rows: DataFrame, spec: TripSpec) -> DataFrame:
    """Rolling features of bounded trips: one exchange of key, order and signals, one sort, one pass."""
    narrow = list(dict.fromkeys([spec.key, *spec.order, *spec.signals]))
    ordered = rows.select(*narrow).repartition(spec.key).sortWithinPartitions(spec.key, *spec.order)
    return _moments_of(ordered, spec, [spec.key], None).selectExpr(q(spec.key), *rolling_outputs(spec))


def rolling_features_hot(frame: DataFrame, spec: TripSpec, block_rows: int) -> DataFrame:
    """Rolling features of huge trips from rows with positions ``_i`` (and sizes ``_n``): blocks with a halo, then the
    moments of a trip's blocks together."""
    blocks = block_with_halo(frame.select(spec.key, "_i", "_n", *spec.signals), block_rows, max(spec.rolling_windows) - 1)
    ordered = blocks.repartition(spec.key, "_blk").sortWithinPartitions(spec.key, "_blk", "_i")
    parts = materialize(_moments_of(ordered, spec, [spec.key, "_blk"], "_halo"))
    columns = range(len(spec.rolling_windows) * len(spec.signals))
    listed = lambda e: "array(" + ", ".join(e.format(k=k) for k in columns) + ")"
    mean = "CASE WHEN sum({p}_n[{{k}}]) > 0 THEN sum({p}_n[{{k}}] * {p}_mean[{{k}}]) / sum({p}_n[{{k}}]) END"
    total = parts.groupBy(spec.key).agg(*[F.expr(f"{listed(e)} AS {name}") for name, e in (
        ("ma_n", "sum(ma_n[{k}])"), ("ma_mean", mean.format(p="ma")), ("sd_n", "sum(sd_n[{k}])"), ("sd_mean", mean.format(p="sd")))])
    # squared deviations about the mean of the whole trip
    off = "sum(sd_m2[{k}] + CASE WHEN sd_n[{k}] > 0 THEN sd_n[{k}] * pow(sd_mean[{k}] - _all[{k}], 2) ELSE 0 END)"
    spread = (join_small(parts.withColumnRenamed("sd_mean", "_mean").selectExpr(q(spec.key), "sd_n", "sd_m2", "_mean AS sd_mean"),
                         total.select(spec.key, F.col("sd_mean").alias("_all")), spec.key)
              .groupBy(spec.key).agg(F.expr(f"{listed(off)} AS sd_m2")))
    return total.join(spread, spec.key).selectExpr(q(spec.key), *rolling_outputs(spec))
