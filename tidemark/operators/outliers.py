"""Implausible bars, judged against the normal behaviour of their own source.

Three tests: physical bounds (prices that contradict each other, prices of zero or less, negative volume);
a Hampel filter (distance from the rolling median in units of the source's median absolute deviation from that
rolling median) on log close, on the wicks above and below the body, and on log volume; run lengths of repeated
values in sources where repeats are unusual. The rolling median is centred, so a lasting move is its own normal on
both sides, while an off-level shorter than half a window stands out with all its bars.

Plan: bars are cut into blocks of ``block_hours``, one row a block with its bars as an array, so that a hot source is
spread over all tasks. Three passes over the blocks (their exchange is written once and read again): the first one
picks the bars at either end of a block that its neighbours need; the second takes the deviations and counts
repeats, as histograms that add up; the third judges. Between the passes only these narrow rows meet by source. A
block's context holds as many readings of each kind as the widest window and the longest run look at, however far
back they lie, so that blocks give exactly what one pass over the whole source would.

Defined cases: null and NaN values are no reading and never a case; repeated rows count once; a bar without
source or time belongs to no series and is not judged; deviations of exactly zero (repeated values) say nothing of
the size of a source's movements and do not count in its median; a source with fewer than ``MIN_BARS`` other
deviations has no normal behaviour to stand out from, so only bounds and runs apply to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_BARS, _MAD, _FINE = 5, 1.4826, 100.0
PRICES = ("open", "high", "low", "close")
READINGS = ("close", "high", "low", "volume")
NARROW, WIDE, VOLUME = 4, 6, 24  # half windows of close, of close and wicks, of volume


def residuals(x: np.ndarray, use: np.ndarray, part: np.ndarray, half: int) -> np.ndarray:
    """Distance of each used value from the median of its ``2 * half + 1`` nearest used values of its part (numbered
    from 0 in order); windows are cut off at the ends of a part. NaN where not used."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(use)
    if len(at):
        # parts are laid out with gaps as wide as half a window between them
        place = np.arange(len(at)) + half * part[at].astype(np.int64)
        laid = np.full(place[-1] + 1, np.nan)
        laid[place] = x[at]
        medians = pd.Series(laid).rolling(2 * half + 1, center=True, min_periods=1).median().to_numpy()
        out[at] = x[at] - medians[place]
    return out


def runs(x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its run's length (0 where missing) and whether it begins the run; missing values do not break one."""
    length, first = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    seen = np.flatnonzero(~np.isnan(x))
    if len(seen):
        y, p = x[seen], part[seen]
        new = np.concatenate([[True], (y[1:] != y[:-1]) | (p[1:] != p[:-1])])
        run = np.cumsum(new) - 1
        length[seen], first[seen] = np.bincount(run)[run], new
    return length, first


class Bars:
    """Bars of one or several parts, each in order of time, with what the tests look at."""

    def __init__(self, o, h, l, c, v, part):  # noqa: E741
        self.v, self.part, self.readings = v, part, (c, h, l, v)
        with np.errstate(invalid="ignore", divide="ignore"):
            top, bottom = np.fmax.reduce([o, l, c]), np.fmin.reduce([o, h, c])
            self.impossible = (h < top) | (l > bottom) | (v < 0)
            for p in (o, h, l, c):
                self.impossible |= p <= 0
            fair = ~self.impossible
            self.close = np.log(np.where(fair, c, np.nan))
            self.wicks = [np.log(np.where(fair, h, np.nan) / np.fmax(o, c)), np.log(np.fmin(o, c) / np.where(fair, l, np.nan))]
            self.volume = np.log(np.where(v > 0, v, np.nan))

    def needed(self, stuck_run: int) -> list[tuple[np.ndarray, int]]:
        """Which bars each window or run looks at, and how many of them on a side."""
        seen = [(np.isfinite(x), k) for x, k in ((self.close, WIDE), (self.wicks[0], WIDE), (self.wicks[1], WIDE), (self.volume, VOLUME))]
        return seen + [(~np.isnan(x), stuck_run) for x in self.readings]

    def deviations(self) -> list[np.ndarray]:
        """From the rolling medians: of the close in the narrow and the wide window, and of the volume."""
        seen = np.isfinite(self.close)
        return [residuals(self.close, seen, self.part, NARROW), residuals(self.close, seen, self.part, WIDE), residuals(self.volume, np.isfinite(self.volume), self.part, VOLUME)]

    def judge(self, scales, usual, spike: float, wide_spike: float, volume_spike: float, least_volume: float, stuck_run: int):
        """Arrays (impossible, far, stuck). ``scales``, ``usual``: for each bar the three deviations of its source (0:
        none) and whether each reading repeats as a rule."""
        narrow, wide, volume = self.deviations()
        by_narrow, by_wide, by_volume = (np.where(s > 0, s, np.inf) for s in scales)
        with np.errstate(invalid="ignore"):
            far = (np.abs(narrow) > spike * by_narrow) | (np.abs(wide) > wide_spike * by_wide)
            for wick in self.wicks:
                far |= residuals(wick, np.isfinite(wick), self.part, WIDE) > spike * by_narrow
            far |= np.abs(volume) > np.maximum(volume_spike * by_volume, least_volume)
        stuck = np.zeros(len(self.part), dtype=bool)
        for values, common in zip(self.readings, usual):
            length, first = runs(values, self.part)
            stuck |= (length >= stuck_run) & ~first & ~common
        return self.impossible, far, stuck


def _last(bars: Bars, stuck_run: int, ahead: bool) -> np.ndarray:
    """Which bars the neighbour of each part needs: the last ones (``ahead``: the first ones) of every kind."""
    parts = int(bars.part[-1]) + 1 if len(bars.part) else 0
    keep = np.zeros(len(bars.part), dtype=bool)
    for seen, count in bars.needed(stuck_run):
        upto = np.cumsum(seen)
        whole = np.bincount(bars.part, weights=seen, minlength=parts).astype(np.int64)
        start = np.cumsum(whole) - whole
        nth = upto - start[bars.part]
        keep |= seen & ((nth <= count) if ahead else (whole[bars.part] - nth < count))
    return keep


def _values(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values, five a bar, of arrays of doubles."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return np.diff(offsets) // 5, lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 5)


def _own(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lengths, values (five a bar) and identifiers of the blocks' own bars."""
    lists = batch["bars"]
    bars = lists.flatten()
    values = np.stack([bars.field(c).to_numpy(zero_copy_only=False).astype(float) for c in (*PRICES, "volume")], axis=1) if len(bars) else np.zeros((0, 5))
    return np.diff(lists.offsets.to_numpy().astype(np.int64)), values, bars.field("id")


def _listed(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), from_pandas=True))


def _ends(stuck_run: int):
    """The bars of a block that its neighbours need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, values, _ = _own(batch)
            part = np.repeat(np.arange(len(n)), n)
            bars = Bars(*values.T, part)
            ends = []
            for ahead in (True, False):
                keep = _last(bars, stuck_run, ahead)
                ends.append(_listed(values[keep], np.bincount(part[keep], minlength=len(n))))
            yield pa.RecordBatch.from_arrays([batch["e"], batch["block"], *ends], names=["e", "block", "head", "tail"])

    return run


def _carry(stuck_run: int):
    """For each block of a source what it needs of the blocks before and after it, carried over blocks that have too little."""

    def trim(values: np.ndarray, ahead: bool) -> np.ndarray:
        return values[_last(Bars(*values.T, np.zeros(len(values), dtype=np.int64)), stuck_run, ahead)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.diff(batch["blocks"].offsets.to_numpy())
            flat = batch["blocks"].flatten()
            block = flat.field("block").to_numpy()
            sides = {c: _values(flat.field(c)) for c in ("head", "tail")}
            at = {c: np.concatenate([[0], np.cumsum(n)]) for c, (n, _) in sides.items()}
            end = lambda c, k: sides[c][1][at[c][k] : at[c][k + 1]]
            before, after = [np.zeros((0, 5))] * len(block), [np.zeros((0, 5))] * len(block)
            start = 0
            for count in of:
                order = start + np.argsort(block[start : start + count], kind="stable")
                for i, k in zip(order, order[1:]):
                    before[k] = trim(np.concatenate([before[i], end("tail", i)]), False)
                for i, k in zip(order[::-1], order[-2::-1]):
                    after[k] = trim(np.concatenate([end("head", i), after[i]]), True)
                start += count
            sides_ = [_listed(np.concatenate([np.zeros((0, 5)), *s]), np.array([len(x) for x in s], dtype=np.int64)) for s in (before, after)]
            yield pa.RecordBatch.from_arrays([batch["e"].take(pa.array(np.repeat(np.arange(len(of)), of))), pa.array(block), *sides_], names=["e", "block", "before", "after"])

    return run


def _whole(batch: pa.RecordBatch) -> tuple[Bars, np.ndarray, pa.Array, np.ndarray]:
    """Blocks with their context: bars, which of them are the blocks' own, the own ones' identifiers, and part of each bar."""
    (a, before), (n, values, ids), (z, after) = _values(batch["before"]), _own(batch), _values(batch["after"])
    part = np.concatenate([np.repeat(np.arange(len(k)), k) for k in (a, n, z)])
    order = np.argsort(part, kind="stable")
    own = np.concatenate([np.zeros(len(before), dtype=bool), np.ones(len(values), dtype=bool), np.zeros(len(after), dtype=bool)])[order]
    part = part[order]
    return Bars(*np.concatenate([before, values, after])[order].T, part), own, ids, part


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms of the deviations of each block's own bars, and its runs: all, and longer than one, a reading."""
    for batch in batches:
        bars, own, _, part = _whole(batch)
        rows = batch.num_rows
        columns = []
        for d in bars.deviations():
            size = np.abs(d)
            use = own & (size > 0)
            bins = np.floor(np.log(size[use]) * _FINE).astype(np.int64)
            keys, counts = np.unique((part[use] << 32) + bins + (1 << 31), return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(keys >> 32, minlength=rows))]).astype(np.int32)
            for x in ((keys & 0xFFFFFFFF) - (1 << 31), counts):
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))))
        for values in bars.readings:
            length, first = runs(values, part)
            for use in (own & first, own & first & (length > 1)):
                columns.append(pa.array(np.bincount(part[use], minlength=rows).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch["e"], batch["block"], batch["before"], batch["after"], *columns], names=["e", "block", "before", "after", *_MEASURES])


_MEASURES = [f"{k}{i}" for i in range(3) for k in ("bins", "counts")] + [f"{k}_{c}" for c in READINGS for k in ("runs", "long")]


def _deviation(bins: np.ndarray, counts: np.ndarray) -> float:
    """1.4826 times the median of the sizes in a histogram; 0 for too few."""
    if counts.sum() < MIN_BARS:
        return 0.0
    order = np.argsort(bins, kind="stable")
    upto = np.cumsum(counts[order])
    return _MAD * float(np.exp((bins[order][np.searchsorted(upto, (upto[-1] + 1) / 2)] + 0.5) / _FINE))


def _normal(usual_repeats: float):
    """The deviations of each source and which of its readings repeat as a rule, for each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch["blocks"].offsets.to_numpy()
            flat = batch["blocks"].flatten()
            source = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            columns = []
            for i in range(3):
                (b, c), edges = (flat.field(f"{k}{i}") for k in ("bins", "counts")), None
                edges = b.offsets.to_numpy()
                bins, counts = b.flatten().to_numpy(), c.flatten().to_numpy().astype(np.int64)
                ends = edges[offsets - offsets[0]] - edges[0]
                found = np.array([_deviation(bins[x:y], counts[x:y]) for x, y in zip(ends, ends[1:])])
                columns.append(pa.array(found[source]))
            for c in READINGS:
                whole, long = (np.bincount(source, weights=flat.field(f"{k}_{c}").to_numpy(), minlength=batch.num_rows) for k in ("runs", "long"))
                columns.append(pa.array((long > usual_repeats * whole)[source]))
            kept = [flat.field(c) for c in ("block", "before", "after")]
            yield pa.RecordBatch.from_arrays([batch["e"].take(pa.array(source)), *kept, *columns], names=["e", "block", "before", "after", *_NORMAL])

    return run


_NORMAL = ["scale0", "scale1", "scale2", *(f"usual_{c}" for c in READINGS)]


def _judge(**limits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bars, own, ids, part = _whole(batch)
            scales = [batch[f"scale{i}"].to_numpy()[part] for i in range(3)]
            usual = [batch[f"usual_{c}"].to_numpy(zero_copy_only=False)[part] for c in READINGS]
            flags = [f[own] for f in bars.judge(scales, usual, **limits)]
            keep = pa.array(np.logical_or.reduce(flags))
            yield pa.RecordBatch.from_arrays([ids.filter(keep), *(pa.array(f).filter(keep) for f in flags)], names=["id", "impossible", "far", "stuck"])

    return run


def implausible_bars(
    df: DataFrame,
    entity: str = "feed_id",
    key: str = "candle_id",
    ts: str = "ts",
    block_hours: int = 2048,
    spike: float = 12.5,
    wide_spike: float = 14.0,
    volume_spike: float = 5.0,
    least_volume: float = 3.0,
    stuck_run: int = 5,
    usual_repeats: float = 0.05,
) -> DataFrame:
    """``key, impossible, far, stuck`` of every bar with at least one of the three flags.

    ``spike``: median absolute deviations (times 1.4826) from the rolling median of nine closes, and for wicks, in the
    same unit, of thirteen; ``wide_spike``: of thirteen closes; ``volume_spike``, ``least_volume``: the same for log volume
    over 49 bars, and its least distance; ``stuck_run``: length of a run of equal values; ``usual_repeats``: share of runs
    longer than one from which repeats are usual for a source. A task holds a block's bars at once: sources with bars far
    shorter than an hour want a smaller ``block_hours``.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    kinds = dict(df.dtypes)
    rows = df.select(F.col(entity).alias("e"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(key).alias("id"), *(number(c) for c in (*PRICES, "volume")))
    # the joins below need keys that are not null; said here, it adds no filter to one branch only, and the exchange is reused
    bars = rows.withColumn("block", F.expr(f"ts div {3_600_000_000 * block_hours}")).where("e is not null and ts is not null and block is not null")
    blocks = bars.groupBy("e", "block").agg(F.array_sort(F.collect_set(F.struct("ts", "id", *PRICES, "volume"))).alias("bars"))
    e, place = f"e {kinds[entity]}, block bigint", "before array<double>, after array<double>"
    by_source = lambda d: d.groupBy("e").agg(F.collect_list(F.struct(*(c for c in d.columns if c != "e"))).alias("blocks"))
    ends = blocks.mapInArrow(_ends(stuck_run), f"{e}, head array<double>, tail array<double>")
    around = by_source(ends).mapInArrow(_carry(stuck_run), f"{e}, {place}")
    measures = ", ".join(f"{c} {'array<int>' if c[-1].isdigit() else 'bigint'}" for c in _MEASURES)
    measured = blocks.join(around, ["e", "block"]).select("e", "block", "bars", "before", "after").mapInArrow(_measure, f"{e}, {place}, {measures}")
    normal = ", ".join(f"{c} {'double' if c.startswith('scale') else 'boolean'}" for c in _NORMAL)
    known = by_source(measured).mapInArrow(_normal(usual_repeats), f"{e}, {place}, {normal}")
    joined = blocks.join(known, ["e", "block"]).select("bars", "before", "after", *_NORMAL)
    limits = {"spike": spike, "wide_spike": wide_spike, "volume_spike": volume_spike, "least_volume": least_volume, "stuck_run": stuck_run}
    found = joined.mapInArrow(_judge(**limits), f"id {kinds[key]}, impossible boolean, far boolean, stuck boolean")
    return found.select(F.col("id").alias(key), "impossible", "far", "stuck")
