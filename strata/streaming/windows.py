"""Sliding windows over a stream: the statistics of ``operators.sliding``, as soon as no row of a window can come any more."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strata.operators.sliding import STATISTICS

#: Series share a state by the hash of their key. ``first``, ``next`` and ``counts`` are 64-bit numbers a series, ``times`` and ``readings`` those of the
#: counted rows, series by series.
STATE = "series array<string>, first binary, next binary, counts binary, times binary, readings binary"

#: The first time of a series that the watermark hasn't passed.
OPEN = np.iinfo(np.int64).min

#: Rows in windows that are looked at at once.
AT_ONCE = 1 << 20


def _runs(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of runs of so many from each beginning, one run after the other."""
    return np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _statistics(t: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows from ``a`` to ``b`` (exclusive) of each window: samples by sensor; and mean, deviation, least, greatest, slope and last minus first of
    each, NaN with fewer than two samples, the slope also at one instant."""
    counts = b - a
    rows, begin, of = _runs(a, counts), np.cumsum(counts) - counts, np.repeat(np.arange(len(a)), counts)
    place, samples, found = np.arange(len(rows)), [], []
    for i in range(y.shape[1]):
        v = y[rows, i]
        has = ~np.isnan(v)
        total = lambda x: np.add.reduceat(np.where(has, x, 0), begin)  # noqa: B023, E731
        n = total(1)
        first, last = np.minimum.reduceat(np.where(has, place, len(place) - 1), begin), np.maximum.reduceat(np.where(has, place, 0), begin)
        with np.errstate(all="ignore"):
            mean = total(v) / n
            off = v - mean[of]
            # from the first sample's time: samples at one instant are exactly so
            x = (t[rows] - t[rows[first]][of]) / 1e6
            x = x - (total(x) / n)[of]
            spread = total(x * x)
            slope = np.where(spread > 0, total(x * off) / spread, np.nan)
            least, most = (f.reduceat(np.where(has, v, e), begin) for f, e in ((np.minimum, np.inf), (np.maximum, -np.inf)))
            stats = np.column_stack([mean, np.sqrt(total(off * off) / n), least, most, slope, v[last] - v[first]])
        samples.append(n)
        found.append(np.where((n >= 2)[:, None], stats, np.nan))
    return np.column_stack(samples), np.column_stack(found)


def sliding_stream(events: DataFrame, series: str, ts: str, sensors: Sequence[str], width_s: int, step_s: int, lateness: str, states: int = 256) -> DataFrame:
    """A row a window with a sample of some sensor: ``series``, ``k``, ``window_start`` (seconds since the series began), ``n_rows``, the statistics of
    all sensors. It equals the batch's windows that end by the watermark.

    The state of a series is its rows that an open window may still need: those of the last width and those ahead of the watermark. A
    series begins with its first row; rows behind the watermark are dropped by Spark. A window is open until a row of its series lies
    at its end or later, as the batch only has windows that the series fills, and the watermark has passed it.

    Python is called for so many ``states`` a batch, not for each series, and goes through the rows of all series of one together. The
    number belongs to a checkpoint, as the shuffle partitions do.
    """
    n, width, step = len(sensors), width_s * 1_000_000, step_s * 1_000_000
    kind = events.schema[series].dataType.simpleString()
    names = ["_series", "k", "window_start", "n_rows", *[f"{s}_{x}" for s in sensors for x in STATISTICS]]
    out = "_series string, k long, window_start long, n_rows long, " + ", ".join(f"`{c}` double" for c in names[4:])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, *packed = state.get if state.exists else ([], b"", b"", b"", b"", b"")
        first, k, counts, t = (np.frombuffer(x, np.int64) for x in packed[:4])
        known, new = len(keys), list(batches)
        t = np.concatenate([t, *[b["_at"].to_numpy(np.int64) for b in new]])
        y = np.concatenate([np.frombuffer(packed[4]).reshape(-1, n), *[b[list(sensors)].to_numpy(float) for b in new]])
        of, keys = pd.factorize(np.concatenate([np.array(keys, object), *[b["_series"].to_numpy(object) for b in new]]))
        of = np.concatenate([np.repeat(np.arange(known), counts), of[known:]])
        order = np.lexsort((t, of))
        of, t, y = of[order], t[order], y[order]
        first, k = (np.concatenate([x, np.full(len(keys) - known, e)]) for x, e in ((first, OPEN), (k, 0)))
        # every series has a row, as its last one is kept
        begin, end = (np.searchsorted(of, np.arange(len(keys)), side) for side in ("left", "right"))
        passed = state.getCurrentWatermarkMs() * 1000
        first = np.where((first == OPEN) & (t[begin] < passed), t[begin], first)
        began, last = first != OPEN, t[end - 1]
        since = np.where(began, first, 0)
        over = np.where(began, (np.minimum(passed, last) - width - since) // step, -1)
        # of each row, the windows from low to high that hold it and are over now; both only grow in a series
        at = t - since[of]
        low, high = np.maximum((at - width) // step + 1, k[of]), np.minimum(at // step, over[of])
        same = of[1:] == of[:-1]
        opened = np.maximum(low, np.append(-1, np.where(same, high[:-1], -1))[: len(low)] + 1)
        closed = np.minimum(high, np.append(np.where(same, low[1:] - 1, high[:-1]), high[-1:]))
        n_opened, n_closed = np.maximum(high - opened + 1, 0), np.maximum(closed - low + 1, 0)
        # windows in order by the first row of each, and in the same order by the last
        number, a, b = _runs(opened, n_opened), np.repeat(np.arange(len(t)), n_opened), np.repeat(np.arange(1, len(t) + 1), n_closed)
        k = np.maximum(k, over + 1)
        kept = (t >= (since + k * step)[of]) | ~began[of]
        # the last row tells how far the series has come
        kept[end - 1] = True
        counts = np.bincount(of[kept], minlength=len(keys))
        state.update((list(keys), *[x.astype(np.int64).tobytes() for x in (first, k, counts, t[kept])], y[kept].tobytes()))
        # without another row, only windows that the series has filled can end
        due = np.where(began, since + k * step + width, t[begin] + 1)[~began | (last >= since + k * step + width)]
        if len(due):
            state.setTimeoutTimestamp(max(int(due.min()) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        cuts = np.unique(np.searchsorted(np.cumsum(b - a), np.arange(AT_ONCE, (b - a).sum(), AT_ONCE)))
        for some in np.split(np.arange(len(a)), cuts) if len(a) else []:
            if len(some):
                samples, found = _statistics(t, y, a[some], b[some])
                has = (samples > 0).any(axis=1)
                rows = pd.DataFrame(found[has], columns=names[4:])
                for i, x in enumerate((keys[of[a[some]]], number[some], number[some] * step_s, b[some] - a[some])):
                    rows.insert(i, names[i], x[has])
                yield rows

    at = F.col(ts).cast("timestamp")
    rows = events.where(F.col(series).isNotNull() & F.col(ts).isNotNull()).select(F.col(series).cast("string").alias("_series"), at.alias(ts), F.unix_micros(at).alias("_at"), *sensors)
    rows = rows.withColumn("_state", F.pmod(F.hash("_series"), F.lit(states))).withWatermark(ts, lateness)
    found = rows.groupBy("_state").applyInPandasWithState(update, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("_series").cast(kind).alias(series), *names[1:])
