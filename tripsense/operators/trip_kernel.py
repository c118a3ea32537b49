"""All features of bounded trips in one pass over rows sorted by trip and order.

Spark shuffles and sorts the rows once; a task walks its trips in chunks of Arrow batches and leaves one row of sums a trip,
from which the SQL expressions of :mod:`tripsense.operators.trip_aggregates` derive the features. A chunk holds whole
trips (a bounded trip has at most ``max_group_rows`` rows), so every sum, order statistic and window is a segment of its arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tripsense import schema as S
from tripsense.operators.rolling import CHUNK_ROWS, rolling_moments, run_moments
from tripsense.operators.trip_aggregates import TripSpec, hann_window, hilbert_envelope_mean, q

#: sums of a channel over a whole trip and over its last records
SUMS = ("n", "min", "max", "sx", "da", "d1", "d2", "d3", "d4", "sa")
LAST_SUMS = SUMS[:-2]
ROLLING = ("ma_n", "ma_mean", "sd_n", "sd_mean", "sd_m2")
SIGNAL_STATS = ("trend", "mean_change", "hann_mean", "hilbert_mean")


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ..`` (``count[k]`` of them) for every k in a row."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def segment_sums(x: np.ndarray, begin: np.ndarray, order: int = 4) -> np.ndarray:
    """``(segment, column, sum)``: count, extremes, sum and sums of |d|, d .. d^order and |x| (order 4), d = x - mean of the
    segment, NaN skipped. Sums of nothing are NaN."""
    known = ~np.isnan(x)
    add = lambda v: np.add.reduceat(v, begin, axis=0)
    n = add(known.astype(np.float64))
    value = np.where(known, x, 0.0)
    total = add(value)
    mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
    d = np.where(known, x - np.repeat(mean, np.diff(np.append(begin, len(x))), axis=0), 0.0)
    out = [n, np.fmin.reduceat(x, begin, axis=0), np.fmax.reduceat(x, begin, axis=0), total, add(np.abs(d))]
    power = d
    for k in range(order):
        out.append(add(power))
        power = power * d if k + 1 < order else power
    if order >= 4:
        out.append(add(np.abs(value)))
    out = np.stack(out, axis=2)
    out[..., 1:][n == 0] = np.nan
    return out


def segment_percentiles(x: np.ndarray, trip: np.ndarray, begin: np.ndarray, probabilities) -> np.ndarray:
    """``(trip, probability)`` of one column, linear between the two neighbouring values; NaN skipped, NaN without values."""
    ordered = x[np.lexsort((x, trip))]
    n = np.add.reduceat((~np.isnan(x)).astype(np.int64), begin)
    out = []
    for p in probabilities:
        pos = np.maximum(n - 1, 0) * p
        low, high = np.floor(pos), np.ceil(pos)
        a, b = ordered[begin + low.astype(np.int64)], ordered[begin + high.astype(np.int64)]
        out.append(np.where(n == 0, np.nan, np.where(a == b, a, np.where(low == high, a, (high - pos) * a + (pos - low) * b))))
    return np.stack(out, axis=1)


def _hann_weights(i: np.ndarray, n: np.ndarray, length: int = S.HANN_LENGTH) -> np.ndarray:
    prefix = np.concatenate([[0.0], np.cumsum(hann_window(length))])
    c = (length - 1) // 2
    low, high = np.maximum(0, c - i), np.minimum(length - 1, n - 1 + c - i)
    inside = high >= low
    return np.where(inside, prefix[np.where(inside, high + 1, 0)] - prefix[np.where(inside, low, 0)], 0.0) / prefix[-1]


def _trend(y: np.ndarray, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Slope of ``y`` on ``x`` over the rows that have both: 0 for one distinct ``x``, NaN without such rows."""
    both = ~np.isnan(x) & ~np.isnan(y)
    pair = np.where(both[:, None], np.column_stack([x, y]), np.nan)
    sums = segment_sums(pair, begin, 1)
    n = sums[:, 0, 0]
    length = np.diff(np.append(begin, len(x)))
    mean = np.divide(sums[:, :, 3], n[:, None], out=np.zeros((len(n), 2)), where=n[:, None] > 0)
    d = np.where(both[:, None], pair - np.repeat(mean, length, axis=0), 0.0)
    xx, xy = np.add.reduceat(d[:, 0] * d[:, 0], begin), np.add.reduceat(d[:, 0] * d[:, 1], begin)
    varied = (n > 1) & (sums[:, 0, 1] < sums[:, 0, 2])
    return np.where(n == 0, np.nan, np.divide(xy, xx, out=np.zeros_like(xx), where=varied & (xx != 0)))


class TripKernel:
    """Turns batches of rows sorted by key and order into one row of sums a trip (see :meth:`fields`)."""

    def __init__(self, spec: TripSpec):
        self.spec = spec
        self.percentiles = [(c, spec.percentiles_of(c)) for c in spec.percentile_channels()]
        self.sequence = spec.has("trend", "mean_change", "hilbert_hann")
        wide = spec.moments or spec.has("last_n")
        self.channels = [c for c in spec.channels if wide or c in spec.signals or c in dict(self.percentiles)]
        self.columns = list(dict.fromkeys([*self.channels, spec.time])) if spec.has("trend") else self.channels

    def fields(self) -> list[str]:
        spec = self.spec
        return [*(["sums"] if spec.moments else []), *(["signals"] if self.sequence else []),
                *(["percentiles"] if self.percentiles else []), *(["last"] if spec.has("last_n") else []),
                *(ROLLING if spec.rolling_windows else [])]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = self._begin(table)[-1]
                if cut:                                    # the last trip may go on in the next batch
                    yield self._rows(table.slice(0, cut))
                    table = table.slice(cut)
                held, rows = table.to_batches(), 0
        held = [b for b in held if b.num_rows]
        if held:
            yield self._rows(pa.Table.from_batches(held).combine_chunks())

    def _begin(self, table: pa.Table) -> np.ndarray:
        key = table[self.spec.key].combine_chunks()
        return np.concatenate([[0], np.asarray(pc.run_end_encode(key).run_ends)[:-1]]).astype(np.int64)

    def _rows(self, table: pa.Table) -> pa.RecordBatch:
        spec, begin = self.spec, self._begin(table)
        key = table[spec.key].combine_chunks().take(pa.array(begin))
        column = {c: table[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in self.columns}
        length = np.diff(np.append(begin, table.num_rows))
        out = {}
        if spec.moments:
            out["sums"] = segment_sums(np.column_stack([column[c] for c in spec.channels]), begin)
        if self.sequence or spec.rolling_windows:
            signals = np.column_stack([column[s] for s in spec.signals])
        if self.sequence:
            out["signals"] = self._signal_stats(signals, column, begin, length, key)
        if self.percentiles:
            trip = np.repeat(np.arange(len(begin)), length)
            out["percentiles"] = np.hstack([segment_percentiles(column[c], trip, begin, ps) for c, ps in self.percentiles])
        if spec.has("last_n"):
            out["last"] = self._last(np.column_stack([column[c] for c in spec.channels]), begin, length, key)
        if spec.rolling_windows:
            first = np.zeros(len(begin), np.int64)
            ma, sd = [], []
            for w in spec.rolling_windows:
                mean, m2 = rolling_moments(signals, begin, first, w)
                ma.append(mean)
                sd.append(np.sqrt(np.maximum(m2, 0.0) / (w - 1)) if w > 1 else np.full_like(m2, np.nan))
            out.update(zip(ROLLING, (*run_moments(np.hstack(ma), begin)[:2], *run_moments(np.hstack(sd), begin))))
        arrays = []
        for name in self.fields():
            flat = out[name].reshape(len(begin), -1)
            offsets = pa.array(np.arange(len(begin) + 1, dtype=np.int32) * flat.shape[1])
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), from_pandas=True)))
        return pa.RecordBatch.from_arrays([key, *arrays], [spec.key, *self.fields()])

    def _change(self, first: np.ndarray, last: np.ndarray, total: np.ndarray, complete: np.ndarray, length: np.ndarray, key) -> np.ndarray:
        """Mean change of the signals of complete segments, in the mode of ``spec``."""
        if self.spec.mean_change == "compat":
            of = key.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            return np.where(complete, total / length[:, None] - of[:, None], np.nan)
        return np.where(complete & (length > 1)[:, None], (last - first) / np.maximum(length - 1, 1)[:, None], np.nan)

    def _signal_stats(self, x: np.ndarray, column: dict, begin: np.ndarray, length: np.ndarray, key) -> np.ndarray:
        spec, out = self.spec, np.full((len(begin), len(SIGNAL_STATS), x.shape[1]), np.nan)
        complete = ~np.logical_or.reduceat(np.isnan(x), begin, axis=0)
        if spec.has("trend"):
            out[:, 0] = np.column_stack([_trend(x[:, k], column[spec.time], begin) for k in range(x.shape[1])])
        if spec.has("mean_change"):
            out[:, 1] = self._change(x[begin], x[begin + length - 1], np.add.reduceat(x, begin, axis=0), complete, length, key)
        if spec.has("hilbert_hann"):
            weight = _hann_weights(np.arange(len(x)) - np.repeat(begin, length), np.repeat(length, length))
            mean = np.add.reduceat(x * weight[:, None], begin, axis=0) / length[:, None]
            out[:, 2] = np.where(complete, mean, np.nan)
            for k, s in enumerate(spec.signals):
                if spec.wants(f"{s}_hilbert_mean"):
                    for t in np.flatnonzero(complete[:, k]).tolist():
                        out[t, 3, k] = hilbert_envelope_mean(x[begin[t]:begin[t] + length[t], k])
        return out

    def _last(self, x: np.ndarray, begin: np.ndarray, length: np.ndarray, key) -> np.ndarray:
        """Sums of all channels and mean changes (latest first) of the signals over the last n records, for every n."""
        at, parts = [self.spec.channels.index(s) for s in self.spec.signals], []
        for n in self.spec.last_n:
            count = np.minimum(length, n)
            rows = ranges(begin + length - count, count)
            start = np.cumsum(count) - count
            sums = segment_sums(x[rows], start, 3)
            signals = x[rows][:, at]
            complete = sums[:, at, 0] == count[:, None]
            change = self._change(signals[start + count - 1], signals[start], sums[:, at, 3], complete, count, key)
            parts += [sums.reshape(len(begin), -1), change]
        return np.hstack(parts)


def trip_sums(rows: DataFrame, spec: TripSpec) -> DataFrame:
    """One row a trip: the key and the arrays of :class:`TripKernel`, by one exchange and one sort of the columns it reads."""
    kernel = TripKernel(spec)
    used = list(dict.fromkeys([spec.key, *spec.order, *kernel.columns]))
    ordered = rows.select(*used).repartition(spec.key).sortWithinPartitions(spec.key, *spec.order)
    schema = ", ".join([f"{q(spec.key)} {dict(rows.dtypes)[spec.key]}", *(f"{f} array<double>" for f in kernel.fields())])
    return ordered.select(*dict.fromkeys([spec.key, *kernel.columns])).mapInArrow(lambda batches: TripKernel(spec)(batches), schema)


def sums_sql(spec: TripSpec) -> dict[str, str]:
    """``_m_<c>_<sum>`` columns of :func:`tripsense.operators.trip_aggregates.moment_outputs` out of ``sums``."""
    return {f"_m_{c}_{s}": f"sums[{k * len(SUMS) + j}]" for k, c in enumerate(spec.channels) for j, s in enumerate(SUMS)}


def signal_outputs(spec: TripSpec) -> dict[str, str]:
    used = {"trend": "trend", "mean_change": "mean_change", "hann_mean": "hilbert_hann", "hilbert_mean": "hilbert_hann"}
    return {f"{s}_{stat}": f"signals[{j * len(spec.signals) + k}]" for j, stat in enumerate(SIGNAL_STATS)
            for k, s in enumerate(spec.signals) if spec.has(used[stat])}


def percentile_sql(spec: TripSpec) -> dict[str, str]:
    """``_pq_<c>`` arrays of :func:`tripsense.operators.trip_aggregates.percentile_outputs` out of ``percentiles``."""
    out, at = {}, 1
    for c in spec.percentile_channels():
        out[f"_pq_{c}"] = f"slice(percentiles, {at}, {len(spec.percentiles_of(c))})"
        at += len(spec.percentiles_of(c))
    return out


def last_sums_sql(spec: TripSpec, n: int) -> dict[str, str]:
    """``_l_<n>_<c>_<sum>`` and ``_mc_<n>_<s>`` out of ``last``."""
    width = len(spec.channels) * len(LAST_SUMS)
    base = spec.last_n.index(n) * (width + len(spec.signals))
    out = {f"_l_{n}_{c}_{s}": f"last[{base + k * len(LAST_SUMS) + j}]" for k, c in enumerate(spec.channels) for j, s in enumerate(LAST_SUMS)}
    out.update({f"_mc_{n}_{s}": f"last[{base + width + k}]" for k, s in enumerate(spec.signals)})
    return out
