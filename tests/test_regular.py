import datetime as dt

import numpy as np

from tidemark.operators.regular import regular_grid, smooth_lockstep

READ, STEP = "feed_id bigint, ts timestamp, close double, value string", "feed_id bigint, step_minutes int"
T0 = dt.datetime(2024, 1, 1)


def dense_smoother(times, y, q, s, r):
    """Posterior mean and variance of the level by plain linear algebra over all states at once."""
    n = len(times)
    precision, info = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    precision[0, 0] += 1e-6
    precision[1, 1] += 1.0
    for k in range(1, n):
        d = times[k] - times[k - 1]
        noise = np.array([[q * d + s * d**3 / 3, s * d * d / 2], [s * d * d / 2, s * d]])
        move = np.hstack([-np.array([[1, d], [0, 1]]), np.eye(2)])
        precision[2 * k - 2 : 2 * k + 2, 2 * k - 2 : 2 * k + 2] += move.T @ np.linalg.inv(noise) @ move
    for k in range(n):
        if not np.isnan(y[k]):
            precision[2 * k, 2 * k] += 1 / r
            info[2 * k] += y[k] / r
    cov = np.linalg.inv(precision)
    return (cov @ info)[::2], np.diag(cov)[::2]


def test_lockstep_equals_one_linear_system():
    rng = np.random.default_rng(2)
    steps = rng.uniform(0.1, 3, (40, 3))
    y = np.cumsum(rng.normal(size=(40, 3)), 0)
    y[rng.random((40, 3)) < 0.4] = np.nan
    y[0] = 0.0
    start, none = [np.zeros(3), np.zeros(3), np.full(3, 1e6), np.zeros(3), np.ones(3)], np.zeros((5, 3))
    level, var, *_ = smooth_lockstep(steps, y, np.full((40, 3), 0.05), start, none, 0.9, 0.01)
    for j in range(3):
        mean, cov = dense_smoother(np.cumsum(steps[:, j]), y[:, j], 0.9, 0.01, 0.05)
        assert np.allclose(level[:, j], mean, atol=1e-4) and np.allclose(var[:, j], cov, atol=1e-4)


def test_blocks_equal_one_pass(spark):
    rng = np.random.default_rng(4)
    t = np.unique(np.sort(rng.uniform(0, 3000, 1500)).round(3))
    t = t[(t < 900) | (t > 1700)]  # a long outage
    y = 100 + np.cumsum(rng.normal(size=len(t)))
    df = spark.createDataFrame([(7, T0 + dt.timedelta(minutes=float(a)), float(b), "x") for a, b in zip(t, y)], READ)
    steps = spark.createDataFrame([(7, 5)], STEP)
    small, whole = ([tuple(r) for r in regular_grid(df, steps, block_steps=b).orderBy("slot_start").collect()] for b in (64, 1 << 20))
    assert [r[:2] + r[4:] for r in small] == [r[:2] + r[4:] for r in whole]
    # also in the middle of the outage
    assert max(abs(a[2] - b[2]) / b[3] for a, b in zip(small, whole)) < 1e-6 and max(abs(a[3] / b[3] - 1) for a, b in zip(small, whole)) < 1e-6
    slots = {int(a // 5) for a in t}
    assert [r[5] for r in whole] == [k not in slots for k in range(min(slots), max(slots) + 1)]
    assert sum(r[4] for r in whole) <= len(t)


def test_edges(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    last = T0 + dt.timedelta(minutes=15) - dt.timedelta(microseconds=1)
    data = [
        (1, at(0), 5.0, "a"), (1, last, 5.0, "a"), (1, at(15), None, "a"), (1, at(20), 0.0, "a"), (1, at(30), float("nan"), "a"), (2, at(3), 1.0, "a"), (2, at(3), 1.0, "a"), (3, at(0), None, "a"), (4, at(0), 1.0, "a"),
        (None, at(0), 1.0, "a"), (5, None, 1.0, "a"), (1, at(45), -1.0, "a"),
    ]
    steps = spark.createDataFrame([(1, 15), (1, 60), (2, 15), (3, 15), (4, None), (5, 15)], STEP)
    got = sorted(tuple(r) for r in regular_grid(spark.createDataFrame(data, READ), steps).collect())
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(1, T0, 2, False), (2, T0, 1, False)]
    assert abs(got[0][2] - 5.0) < 1e-6
    assert regular_grid(spark.createDataFrame([], READ), steps).collect() == []


def test_grid_equals_one_linear_system(spark):
    """Values and deviations of a whole source, blocks and averages included, against plain linear algebra."""
    rng = np.random.default_rng(8)
    t = np.unique(rng.uniform(2, 400, 90).round(2))
    t = np.concatenate([t[(t < 130) | (t > 260)], [399.0, 399.01]])
    y = 50 + np.cumsum(rng.normal(size=len(t)))
    df = spark.createDataFrame([(7, T0 + dt.timedelta(minutes=float(a)), float(b), "x") for a, b in zip(t, y)], READ)
    got = [tuple(r) for r in regular_grid(df, spark.createDataFrame([(7, 5)], STEP), block_steps=8, merge=None).orderBy("slot_start").collect()]
    at = np.array([(r[1] - T0).total_seconds() / 300 for r in got])
    times, values = np.concatenate([at, t / 5]), np.concatenate([np.full(len(at), np.nan), y - y[0]])
    order = np.argsort(times, kind="stable")
    times, values = times[order], values[order]
    keep = np.concatenate([[True], np.diff(times) > 0])  # a step that begins with a reading is one row
    unit = np.square(np.diff(y)).sum() / ((t[-1] - t[0]) / 5)
    mean, var = dense_smoother(times[keep], values[keep] / np.sqrt(unit), 0.9, 0.01, 0.05)
    found = {float(a): (m, s) for a, m, s in zip(times[keep], mean * np.sqrt(unit) + y[0], np.sqrt(var * unit))}
    assert max(abs(r[2] - found[float(a)][0]) for a, r in zip(at, got)) < 1e-4 and max(abs(r[3] - found[float(a)][1]) for a, r in zip(at, got)) < 1e-4


def test_more_readings_weigh_more(spark):
    steps = spark.createDataFrame([(1, 5), (2, 5)], STEP)
    once = [(f, T0 + dt.timedelta(minutes=5 * k), 100.0 + k % 3, "x") for f in (1, 2) for k in range(9)]
    many = [(2, T0 + dt.timedelta(minutes=20, microseconds=i), 101.0 + 1e-9 * i, "x") for i in range(1, 40)]
    got = {(r.feed_id, r.slot_start): (r.sd, r.readings) for r in regular_grid(spark.createDataFrame(once + many, READ), steps).collect()}
    at = T0 + dt.timedelta(minutes=20)
    assert got[2, at][1] == 40 and got[2, at][0] < 0.5 * got[1, at][0]


def test_an_outage_of_a_million_steps_needs_no_memory():
    from tracemalloc import get_traced_memory, start, stop

    import pyarrow as pa

    from tidemark.operators.regular import _reduce, _smooth, _states

    step = 60_000_000
    r = pa.array([[{"t": k * step, "y": 1.0 + k % 2, "n": 1} for k in range(s, s + 40)] for s in (0, 1_000_000)], pa.list_(pa.struct([("t", pa.int64()), ("y", pa.float64()), ("n", pa.int64())])))
    blocks = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([0, 1]), pa.array([step, step]), r], names=["e", "block", "step", "r"])
    (narrow,) = _reduce(0.9, 0.01, 0.05)(iter([blocks]))
    rows = [{c: narrow[c][k].as_py() for c in narrow.schema.names if c != "e"} for k in range(2)]
    (states,) = _states(0.9, 0.01)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([rows])], names=["e", "blocks"])]))
    joined = pa.RecordBatch.from_arrays([*blocks.columns, *(states[c] for c in states.schema.names[2:])], names=[*blocks.schema.names, *states.schema.names[2:]])
    start()
    count = sum(b.num_rows for b in _smooth(0.9, 0.01, 0.05)(iter([joined])))
    peak = get_traced_memory()[1]
    stop()
    assert count == 1_000_040 and peak < 100e6
