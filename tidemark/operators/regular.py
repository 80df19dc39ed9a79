"""Irregular readings onto a regular grid by a Kalman smoother with a continuous-time local trend.

State: level and slope; between two times dt steps apart the level takes noise ``level_noise * dt`` and the
slope ``slope_noise * dt`` (integrated into the level), a reading has variance ``reading_noise`` (a mean of n readings
the nth part); all three are in units of the source's own variance a step, so the same values serve every source.
Each step of the grid gets the smoothed level at its start, a standard deviation, the number of its readings and a
missing flag.

Plan: readings are cut into blocks of ``block_steps`` steps, one row a block. A block's readings, as a function of the
state at its start, are a linear map and a likelihood of 14 numbers, and these compose; so a first pass reduces every
block to its 14 numbers, the narrow table of them is run through forwards and backwards a source, and a second pass
smooths each block between the exact states at its two ends. The result is that of one pass over the whole source, and
a hot source is spread over all tasks. All blocks of a batch run through the recursions together. Steps
between two blocks have a closed form in the states on either side and are written in pieces, so an outage needs no memory.

Readings within a sixteenth (``merge``) of a step are averaged first, which bounds a block by ``merge * block_steps``
values; with ``merge`` None only readings of one instant are.

Defined cases: a null, NaN, infinite, zero or negative value is no reading; a row without source, time or grid
step is left out; repeated rows count once and readings at one instant are averaged; a source with one
reading gives one step; sources without readings give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CELLS, PIECE = 1 << 17, 1 << 16
LEVEL_PRIOR, SLOPE_PRIOR = 1e6, 1.0


def _moved(m0, m1, a, b, c, d, level_noise: float, slope_noise: float):
    """Mean and covariance (a, b; b, c) of the state d steps later."""
    d2 = d * d
    return m0 + d * m1, m1, a + 2 * d * b + d2 * c + level_noise * d + slope_noise * d * d2 / 3, b + d * c + slope_noise * d2 / 2, c + slope_noise * d


def _back(state, predicted, later, d):
    """Smoothed state from the filtered one, the prediction for d steps later and the smoothed state there."""
    m0, m1, a, b, c = state
    p0, p1, pa_, pb, pc = predicted
    s0, s1, va, vb, vc = later
    det = np.maximum(pa_ * pc - pb * pb, 1e-300)
    u00, u01, u10, u11 = a + d * b, b, b + d * c, c
    g00, g01 = (u00 * pc - u01 * pb) / det, (u01 * pa_ - u00 * pb) / det
    g10, g11 = (u10 * pc - u11 * pb) / det, (u11 * pa_ - u10 * pb) / det
    e0, e1 = s0 - p0, s1 - p1
    da, db, dc = va - pa_, vb - pb, vc - pc
    t00, t01, t10, t11 = g00 * da + g01 * db, g00 * db + g01 * dc, g10 * da + g11 * db, g10 * db + g11 * dc
    return m0 + g00 * e0 + g01 * e1, m1 + g10 * e0 + g11 * e1, a + t00 * g00 + t01 * g01, b + t00 * g10 + t01 * g11, c + t10 * g10 + t11 * g11


def smooth_lockstep(dt: np.ndarray, y: np.ndarray, noise: np.ndarray, start, ahead, level_noise: float, slope_noise: float):
    """Smoothed level and variance, each (steps, series), of series run side by side; and of the first row the
    predicted and the smoothed state (level, slope, and three covariances).

    ``dt``: time since the previous row, ``y``: reading or NaN, ``noise``: its variance; all (steps, series). ``start``: state
    predicted for the first row, five arrays; ``ahead``: information on the last row's state from later readings, two and
    three arrays.
    """
    steps, width = y.shape
    state = start
    kept, predicted = np.empty((5, steps, width)), np.empty((5, steps, width))
    for k in range(steps):
        if k:
            state = _moved(*state, dt[k], level_noise, slope_noise)
        predicted[:, k] = state
        p0, p1, pa_, pb, pc = state
        seen = ~np.isnan(y[k])
        s = np.where(seen, pa_ + noise[k], np.inf)
        g0, g1 = pa_ / s, pb / s
        off = np.where(seen, y[k] - p0, 0.0)
        state = p0 + g0 * off, p1 + g1 * off, (1 - g0) * pa_, (1 - g0) * pb, pc - g1 * pb
        kept[:, k] = state
    # the later readings count like one more at the last row: (P^-1 + L)^-1
    m0, m1, a, b, c = state
    h0, h1, la, lb, lc = ahead
    w00, w01, w10, w11 = 1 + a * la + b * lb, a * lb + b * lc, b * la + c * lb, 1 + b * lb + c * lc
    det = w00 * w11 - w01 * w10
    r0, r1 = m0 + a * h0 + b * h1, m1 + b * h0 + c * h1
    late = (w11 * r0 - w01 * r1) / det, (w00 * r1 - w10 * r0) / det, (w11 * a - w01 * b) / det, (w11 * b - w01 * c) / det, (w00 * c - w10 * b) / det
    level, var = np.empty((steps, width)), np.empty((steps, width))
    level[-1], var[-1] = late[0], late[2]
    for k in range(steps - 2, -1, -1):
        late = _back(kept[:, k], predicted[:, k + 1], late, dt[k + 1])
        level[k], var[k] = late[0], late[2]
    return level, np.maximum(var, 0.0), predicted[:, 0], late


def block_maps(dt: np.ndarray, y: np.ndarray, noise: np.ndarray, level_noise: float, slope_noise: float) -> np.ndarray:
    """The 14 numbers of each series: with x the state before its first reading, the state at its last one is normal with
    mean A x + b and covariance C, and its readings weigh like the information eta, J on x. Order: A row by row, b, C, eta, J."""
    steps, width = y.shape
    a00, a01, a10, a11 = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    b0, b1, c00, c01, c11, e0, e1, j00, j01, j11 = np.zeros((10, width))
    for k in range(steps):
        if k:
            d = dt[k]
            a00, a01 = a00 + d * a10, a01 + d * a11
            b0, b1, c00, c01, c11 = _moved(b0, b1, c00, c01, c11, d, level_noise, slope_noise)
        seen = ~np.isnan(y[k])
        s = np.where(seen, c00 + noise[k], np.inf)
        off = np.where(seen, y[k] - b0, 0.0)
        e0, e1 = e0 + a00 * off / s, e1 + a01 * off / s
        j00, j01, j11 = j00 + a00 * a00 / s, j01 + a00 * a01 / s, j11 + a01 * a01 / s
        g0, g1 = c00 / s, c01 / s
        b0, b1 = b0 + g0 * off, b1 + g1 * off
        c00, c01, c11 = (1 - g0) * c00, (1 - g0) * c01, c11 - g1 * c01
        a00, a01, a10, a11 = (1 - g0) * a00, (1 - g0) * a01, a10 - g1 * a00, a11 - g1 * a01
    return np.stack([a00, a01, a10, a11, b0, b1, c00, c01, c11, e0, e1, j00, j01, j11])


def _sets(size: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of series of much the same size, few enough at once."""
    order = np.argsort(size, kind="stable")
    i = len(order)
    while i > 0:
        width = max(1, CELLS // max(int(size[order[i - 1]]), 1))
        yield order[max(i - width, 0) : i]
        i -= width


def _readings(batch: pa.RecordBatch):
    lists = batch["r"]
    flat = lists.flatten()
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0], flat.field("t").to_numpy(), flat.field("y").to_numpy(), flat.field("n").to_numpy()


_NARROW = ["t0", "t1", "y0", "y1", "moved"]


def _reduce(level_noise: float, slope_noise: float, reading_noise: float):
    """First pass: times and values at the ends of a block, its sum of squared differences, and its map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, t, y, n = _readings(batch)
            step, rows = batch["step"].to_numpy(), batch.num_rows
            maps, moved = np.empty((rows, 14)), np.empty(rows)
            for part in _sets(np.diff(at)):
                longest = int(np.diff(at)[part].max())
                dt, ys, noise = np.zeros((longest, len(part))), np.full((longest, len(part)), np.nan), np.ones((longest, len(part)))
                for j, r in enumerate(part):
                    s, e = at[r], at[r + 1]
                    dt[1 : e - s, j] = np.diff(t[s:e]) / step[r]
                    ys[: e - s, j] = y[s:e] - y[s]
                    noise[: e - s, j] = reading_noise / n[s:e]
                    moved[r] = np.square(np.diff(y[s:e])).sum()
                # the map does not depend on the unit of the readings, but for b and eta, which are in it
                maps[part] = block_maps(dt, ys, noise, level_noise, slope_noise).T
            first, last = at[:-1], at[1:] - 1
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * 14)
            ends = [pa.array(x) for x in (t[first], t[last], y[first], y[last], moved)]
            yield pa.RecordBatch.from_arrays([batch["e"], batch["block"], batch["step"], *ends, pa.ListArray.from_arrays(offsets, pa.array(maps.reshape(-1)))], names=["e", "block", "step", *_NARROW, "map"])

    return run


def _matrix(a, b, c, d):
    return np.stack([np.stack([a, b], -1), np.stack([c, d], -1)], -2)


def _states(level_noise: float, slope_noise: float):
    """For every block of a source the state and time at the end of the one before it, and what later ones say of its end."""
    one = np.eye(2)

    def shift(d: np.ndarray):
        z = np.zeros_like(d)
        move = _matrix(z + 1, d, z, z + 1)
        return move, _matrix(level_noise * d + slope_noise * d**3 / 3, slope_noise * d * d / 2, slope_noise * d * d / 2, slope_noise * d)

    t_ = lambda x: np.swapaxes(x, -1, -2)
    v = lambda x, y: np.einsum("...ij,...j->...i", x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.diff(batch["blocks"].offsets.to_numpy()).astype(np.int64)
            flat = batch["blocks"].flatten()
            block = flat.field("block").to_numpy()
            source = np.repeat(np.arange(len(of)), of)
            order = np.lexsort((block, source))
            block, step = block[order], flat.field("step").to_numpy()[order].astype(float)
            t0, t1, y0, y1, moved = (flat.field(c).to_numpy()[order] for c in _NARROW)
            maps = flat.field("map").flatten().to_numpy().reshape(-1, 14)[order]
            first = np.concatenate([[0], np.cumsum(of)[:-1]]).astype(np.int64)
            new = np.zeros(len(source), dtype=bool)
            new[first] = True
            # variance a step of the source; a constant one gets a floor far below its size
            near = np.concatenate([[0.0], np.square(y0[1:] - y1[:-1])]) * ~new
            span = np.bincount(source, (t1 - t0) / step, len(of)) + np.bincount(source, np.concatenate([[0.0], (t0[1:] - t1[:-1])]) * ~new / step, len(of))
            total = np.bincount(source, moved + near, len(of))
            size = np.maximum.reduceat(np.abs(y0), first) if len(first) else np.zeros(0)
            scale = np.maximum(np.sqrt(np.where((span > 0) & (total > 0), total / np.where(span > 0, span, 1), 0.0)), size * 1e-9)[source]
            origin = y0[first][source]
            # into the source's unit and origin
            a = maps[:, :4].reshape(-1, 2, 2)
            c, j = _matrix(*maps[:, [6, 7, 7, 8]].T), _matrix(*maps[:, [11, 12, 12, 13]].T)
            lift = np.stack([(y0 - origin) / scale, np.zeros(len(y0))], -1)
            b = maps[:, 4:6] / scale[:, None] + lift - v(a, lift)
            eta = maps[:, 9:11] / scale[:, None] + v(j, lift)
            left = np.where(new, np.floor(t0 / step) * step, np.concatenate([[0], t1[:-1]]))
            gap = (t0 - left) / step
            move, noise = shift(gap)
            mean, cov = np.zeros((len(source), 2)), np.tile(np.diag([LEVEL_PRIOR, SLOPE_PRIOR]), (len(source), 1, 1))
            info, weight = np.zeros((len(source), 2)), np.zeros((len(source), 2, 2))
            most = int(of.max()) if len(of) else 0
            for k in range(most - 1):
                i = (first + k)[of > k + 1]
                m, p = v(move[i], mean[i]), move[i] @ cov[i] @ t_(move[i]) + noise[i]
                w = np.linalg.inv(one + p @ j[i])
                mean[i + 1] = v(a[i] @ w, m + v(p, eta[i])) + b[i]
                q = a[i] @ w @ p @ t_(a[i]) + c[i]
                cov[i + 1] = (q + t_(q)) / 2
            for k in range(most - 1, 0, -1):
                i = (first + k)[of > k]
                w = t_(a[i]) @ np.linalg.inv(one + weight[i] @ c[i])
                h, l = v(w, info[i] - v(weight[i], b[i])) + eta[i], w @ weight[i] @ a[i] + j[i]  # noqa: E741
                w = t_(move[i]) @ np.linalg.inv(one + l @ noise[i])
                q = w @ l @ move[i]
                info[i - 1], weight[i - 1] = v(w, h), (q + t_(q)) / 2
            known = np.concatenate([mean, cov.reshape(-1, 4)[:, [0, 1, 3]], info, weight.reshape(-1, 4)[:, [0, 1, 3]]], axis=1)
            offsets = pa.array(np.arange(len(source) + 1, dtype=np.int32) * 10)
            columns = [pa.array(block), pa.array(scale), pa.array(origin), pa.array(left.astype(np.int64)), pa.array(new), pa.ListArray.from_arrays(offsets, pa.array(known.reshape(-1)))]
            yield pa.RecordBatch.from_arrays([batch["e"].take(pa.array(source)), *columns], names=["e", "block", "scale", "origin", "left", "starts", "known"])

    return run


def _smooth(level_noise: float, slope_noise: float, reading_noise: float):
    """Second pass: the steps of each block, and those between it and the block before it."""

    def rows(batch: pa.RecordBatch, r: np.ndarray, slot, step, level, sd, count) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch["e"].take(pa.array(r)), pa.array(slot * step[r]), pa.array(level), pa.array(sd), pa.array(count.astype(np.int64)), pa.array(count == 0)],
            names=["e", "at", "value", "sd", "readings", "missing"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, t, y, n = _readings(batch)
            step, left, starts = batch["step"].to_numpy(), batch["left"].to_numpy(), batch["starts"].to_numpy(zero_copy_only=False)
            scale, origin = batch["scale"].to_numpy(), batch["origin"].to_numpy()
            known = batch["known"].flatten().to_numpy().reshape(-1, 10).T
            t0, t1 = t[at[:-1]], t[at[1:] - 1]
            # steps that begin after the block before ends, up to the one of the first reading; then those up to the last one
            since, upto, last = np.where(starts, left // step, left // step + 1), t0 // step, t1 // step
            gap = (t0 - left) / step
            early, late = np.empty((5, batch.num_rows)), np.empty((5, batch.num_rows))
            at_first = np.zeros(batch.num_rows, dtype=np.int64)
            for part in _sets(np.diff(at) + last - upto):
                longest = int((np.diff(at) + last - upto)[part].max())
                shape = (longest, len(part))
                dt, ys, noise = np.zeros(shape), np.full(shape, np.nan), np.ones(shape)
                places, counts, slots = [], [], []
                for j, r in enumerate(part):
                    s, e = at[r], at[r + 1]
                    own = np.arange(upto[r] + 1, last[r] + 1)
                    times = np.concatenate([own * step[r] - t0[r], t[s:e] - t0[r]]) / step[r]
                    by = np.argsort(times, kind="stable")
                    dt[1 : len(by), j] = np.diff(times[by])
                    place = np.empty(len(by), dtype=np.int64)
                    place[by] = np.arange(len(by))
                    ys[place[len(own) :], j] = (y[s:e] - origin[r]) / scale[r]
                    noise[place[len(own) :], j] = reading_noise / n[s:e]
                    number = np.bincount((t[s:e] // step[r] - upto[r]).astype(np.int64), weights=n[s:e], minlength=len(own) + 1)
                    at_first[r] = number[0]
                    places.append(place[: len(own)])
                    counts.append(number[1:])
                    slots.append(own)
                start = _moved(*known[:5, part], gap[part], level_noise, slope_noise)
                level, var, early[:, part], late[:, part] = smooth_lockstep(dt, ys, noise, start, known[5:, part], level_noise, slope_noise)
                lengths = [len(p) for p in places]
                if sum(lengths):
                    r, col, row = np.repeat(part, lengths), np.repeat(np.arange(len(part)), lengths), np.concatenate(places)
                    yield rows(batch, r, np.concatenate(slots), step, level[row, col] * scale[r] + origin[r], np.sqrt(var[row, col]) * scale[r], np.concatenate(counts))

            def between(pieces: list[tuple[int, int, int]]) -> pa.RecordBatch:
                r = np.repeat([p[0] for p in pieces], [p[2] - p[1] for p in pieces])
                slot = np.concatenate([np.arange(p[1], p[2]) for p in pieces])
                since_left = (slot * step[r] - left[r]) / step[r]
                here = _moved(*known[:5, r], since_left, level_noise, slope_noise)
                level, _, var, _, _ = _back(here, early[:, r], late[:, r], (t0[r] - slot * step[r]) / step[r])
                return rows(batch, r, slot, step, level * scale[r] + origin[r], np.sqrt(np.maximum(var, 0.0)) * scale[r], np.where(slot == upto[r], at_first[r], 0))

            pieces, size = [], 0
            for r in range(batch.num_rows):
                for a in range(since[r], upto[r] + 1, PIECE):
                    b = min(a + PIECE, upto[r] + 1)
                    pieces.append((r, a, b))
                    size += b - a
                    if size >= PIECE:
                        yield between(pieces)
                        pieces, size = [], 0
            if pieces:
                yield between(pieces)

    return run


def regular_grid(
    readings: DataFrame,
    steps: DataFrame,
    entity: str = "feed_id",
    ts: str = "ts",
    value: str = "close",
    step_minutes: str = "step_minutes",
    block_steps: int = 512,
    merge: int | None = 16,
    level_noise: float = 0.9,
    slope_noise: float = 0.01,
    reading_noise: float = 0.05,
) -> DataFrame:
    """``entity, slot_start, value, sd, readings, missing``: one row for each grid step from the step of the
    source's first reading to that of its last. ``steps`` gives each source's ``step_minutes``; of several
    the smallest counts. Steps start at whole multiples of their length since 1970."""
    lengths = steps.select(F.col(entity).alias("e"), (F.col(step_minutes).cast("bigint") * 60_000_000).alias("step")).where("step > 0").groupBy("e").agg(F.min("step").alias("step"))
    v = F.col(value).cast("double")
    usable = (v > 0) & (v < float("inf")) & ~F.isnan(v)
    seen = readings.where(usable & F.col(ts).isNotNull()).select(F.col(entity).alias("e"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), v.alias("y"))
    # one exchange by block serves the removal of repeats, the averages and the arrays; the joins below need keys that
    # are not null: said here, it adds no filter to one branch only
    size = f"(step * {block_steps})"
    placed = seen.join(lengths, "e").withColumn("block", F.expr(f"(t - pmod(t, {size})) div {size}")).where("e is not null and block is not null").repartition("e", "block")
    # averages of times are taken as distances from the start of their part of a step: sums stay small and exact
    micro = f"(t * {merge} - pmod(t * {merge}, step)) div step" if merge else "t"
    origin = f"((micro * step - pmod(micro * step, {merge})) div {merge})" if merge else "micro"
    merged = placed.distinct().withColumn("micro", F.expr(micro)).groupBy("e", "block", "micro").agg(F.max("step").alias("step"), F.sum(F.expr(f"t - {origin}")).alias("d"), F.sum("y").alias("y"), F.count("*").alias("n"))
    rows_ = merged.select("e", "block", "step", F.expr(f"{origin} + d div n").alias("t"), (F.col("y") / F.col("n")).alias("y"), "n")
    blocks = rows_.groupBy("e", "block").agg(F.max("step").alias("step"), F.array_sort(F.collect_list(F.struct("t", "y", "n"))).alias("r"))
    e = f"e {dict(readings.dtypes)[entity]}, block bigint"
    noise = level_noise, slope_noise
    narrow = blocks.mapInArrow(_reduce(*noise, reading_noise), f"{e}, step bigint, t0 bigint, t1 bigint, y0 double, y1 double, moved double, map array<double>")
    by_source = narrow.groupBy("e").agg(F.collect_list(F.struct("block", "step", *_NARROW, "map")).alias("blocks"))
    states = by_source.mapInArrow(_states(*noise), f"{e}, scale double, origin double, left bigint, starts boolean, known array<double>")
    joined = blocks.join(states, ["e", "block"]).select("e", "step", "r", "scale", "origin", "left", "starts", "known")
    out = joined.mapInArrow(_smooth(*noise, reading_noise), f"{e.split(',')[0]}, at bigint, value double, sd double, readings bigint, missing boolean")
    return out.select(F.col("e").alias(entity), F.timestamp_micros("at").alias("slot_start"), "value", "sd", "readings", "missing")
