import datetime as dt

import numpy as np

from tidemark.operators.outliers import implausible_bars, residuals, runs

SCHEMA = "candle_id bigint, feed_id bigint, ts timestamp, open double, high double, low double, close double, volume double, far int"
T0 = dt.datetime(2024, 1, 1)


def series(n=400, seed=1, start=1, feed=1, hours=None):
    rng = np.random.default_rng(seed)
    c = 50 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    o = np.concatenate([c[:1], c[:-1]])
    h, low = np.maximum(o, c) * np.exp(rng.exponential(0.001, n)), np.minimum(o, c) * np.exp(-rng.exponential(0.001, n))
    v = np.exp(rng.normal(8, 0.5, n))
    return [[start + i, feed, T0 + dt.timedelta(hours=i), o[i], h[i], low[i], c[i], v[i], 0] for i in range(n)]


def found(spark, data, **kw):
    df = spark.createDataFrame([[x if x is None or not isinstance(x, np.floating) else float(x) for x in r] for r in data], SCHEMA)
    return {r.candle_id: (r.impossible, r.far, r.stuck) for r in implausible_bars(df, **kw).collect()}


def test_planted_cases(spark):
    data = series()
    data[50][6] *= 1.2  # close up, out of the bar's range
    data[80][6], data[80][4] = data[80][6] * 1.2, data[80][6] * 1.21  # a spike the range agrees with
    data[120][4] *= 1.15  # wick
    data[150][7] *= 500
    data[170][7] = -1.0
    data[171][5] = 0.0
    for k in range(200, 203):  # off level for three bars
        data[k][3:7] = [x * 10 for x in data[k][3:7]]
    for k in range(300, 400):  # a lasting move
        data[k][3:7] = [x * 1.4 for x in data[k][3:7]]
    for k in range(230, 240):  # stuck volume
        data[k][7] = data[229][7]
    data[260][7] = None
    got = found(spark, data + data[:30])
    ids = lambda f: sorted(k - 1 for k, v in got.items() if v[f])
    assert ids(0) == [50, 170, 171]
    assert ids(1) == [80, 120, 150, 200, 201, 202]
    assert ids(2) == list(range(230, 240))


def test_blocks_make_no_difference(spark):
    data = series(700, 2) + series(300, 3, 10_000, 2)
    for k in range(95, 130):
        data[k][6] = data[94][6]
        data[k][4], data[k][5] = max(data[k][4], data[k][6]), min(data[k][5], data[k][6])
    data[513][6], data[513][4] = data[513][6] * 1.3, data[513][6] * 1.31
    assert found(spark, data, block_hours=100) == found(spark, data, block_hours=1 << 20)


def test_usual_repeats_are_no_case(spark):
    data = series(300, 5)
    for k in range(1, 300):
        if k % 3:
            data[k][3:8] = [data[k - 1][6]] * 4 + [0.0]
    assert not any(v[2] for v in found(spark, data).values())


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert implausible_bars(empty).collect() == []
    data = [[1, None, T0, 1.0, 1.0, 1.0, 0.0, 1.0, 0], [2, 1, None, 1.0, 1.0, 1.0, 0.0, 1.0, 0], [3, 1, T0, None, None, None, None, None, 0], [4, 2, T0, 1.0, float("nan"), 1.0, -1.0, None, 0]]
    assert found(spark, data) == {4: (True, False, False)}


def test_far_context_makes_no_difference(spark):
    data = series(900, 7)
    for k in range(298, 301):
        data[k][7] = data[297][7]
    for k in range(301, 640):  # a stuck run goes on behind a long stretch without volume
        data[k][7] = None
    data[640][7] = data[641][7] = data[297][7]
    for k in range(640, 800):
        if k % 9:
            data[k][4:7] = [None] * 3
    whole = found(spark, data, block_hours=1 << 20)
    assert {x for x, v in whole.items() if v[2]} == {299, 300, 301, 641, 642}
    assert found(spark, data, block_hours=20) == whole and found(spark, data, block_hours=100) == whole


def test_a_walk_with_flat_bodies_is_normal(spark):
    rng = np.random.default_rng(11)
    c = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 20_000)))
    data = [[i, 1, T0 + dt.timedelta(hours=i), x, x * 1.0001, x * 0.9999, x, 5.0 + i % 7, 0] for i, x in enumerate(c.tolist())]
    assert len(found(spark, data)) < 20


def test_residuals_and_runs():
    rng = np.random.default_rng(0)
    x, part = rng.normal(size=60), np.repeat([0, 1, 2], [30, 1, 29])
    use = rng.random(60) < 0.8
    for half in (4, 20):
        got = residuals(x, use, part, half)
        for k in range(3):
            own = x[use & (part == k)]
            want = [v - np.median(own[max(0, i - half) : i + half + 1]) for i, v in enumerate(own)]
            assert np.allclose(got[use & (part == k)], want)
        assert np.isnan(got[~use]).all()
    nan = float("nan")
    length, first = runs(np.array([1.0, 1.0, nan, 1.0, 2.0, 2.0]), np.array([0, 0, 0, 0, 0, 1]))
    assert length.tolist() == [3, 3, 0, 3, 1, 1] and first.tolist() == [True, False, False, False, True, True]
