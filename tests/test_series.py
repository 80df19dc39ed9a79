import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tests.conftest import rows
from tidemark.functions.text import day_of, identifier_key
from tidemark.operators import backtest as R, bars as B, indicators as I, levels as L, states as S, zones as Z
from tidemark.operators.scoring import prices_in

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def walk(n, seed=42, symbol="a"):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    o = np.concatenate([c[:1], c[:-1]])
    h, low = np.maximum(o, c) * 1.002, np.minimum(o, c) * 0.998
    return [(symbol, T0 + dt.timedelta(days=i), *map(float, (o[i], h[i], low[i], c[i], 10 + i % 7))) for i in range(n)]


def test_flat_and_short_series(spark):
    flat = spark.createDataFrame([("f", T0 + dt.timedelta(days=i), 100.0, 100.0, 100.0, 100.0, 1.0) for i in range(60)] + walk(5, symbol="s"), BAR)
    got = {(r.symbol, r.ts): r.rsi for r in I.rsi_simple(flat).collect()}
    assert got["f", T0 + dt.timedelta(days=59)] == 100.0 and got["f", T0 + dt.timedelta(days=9)] is None and got["s", T0 + dt.timedelta(days=4)] is None
    assert {r.symbol: r.atr for r in I.atr_last(flat).collect()}["f"] == 0.0
    assert len(I.recurrent_indicators(flat).collect()) == 65
    comp = {(r.symbol, r.ts): r for r in S.risk_composite(flat).collect()}
    assert comp["f", T0 + dt.timedelta(days=59)].n_positive == 1  # only the drawdown feature is positive


def test_values_do_not_change_when_bars_are_appended(spark):
    long, short = spark.createDataFrame(walk(120), BAR), spark.createDataFrame(walk(90), BAR)
    for f in (I.rsi_simple, I.risk_features, I.recurrent_indicators, lambda b: S.debounced(S.trend_regime(b, 20, 5), 3)):
        a, b = ({r.ts: r.asDict() for r in f(x).collect()} for x in (long, short))
        for ts, row in b.items():
            for k, v in row.items():
                assert a[ts][k] == v or abs(a[ts][k] - v) < 1e-9, k


def test_adx_against_plain_loop():
    bars = walk(80)
    h, low, c = (np.array([b[k] for b in bars]) for k in (3, 4, 5))
    got = I.recurrences(h, low, c)
    p, n = 14, len(c)
    tr, dp, dm = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        tr[i] = max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1]))
        up, down = h[i] - h[i - 1], low[i - 1] - low[i]
        dp[i], dm[i] = (up if up > down and up > 0 else 0), (down if down > up and down > 0 else 0)
    a, x, y = tr[1 : p + 1].mean(), dp[1 : p + 1].mean(), dm[1 : p + 1].mean()
    dx = []
    for i in range(p + 1, n):
        a, x, y = ((v * (p - 1) + w[i]) / p for v, w in ((a, tr), (x, dp), (y, dm)))
        dx.append(100 * abs(x - y) / (x + y))
    adx = np.mean(dx[:p])
    for v in dx[p:]:
        adx = (adx * (p - 1) + v) / p
    assert abs(got["core_adx"][-1] - adx) < 1e-9 and abs(got["core_di_plus"][-1] - 100 * x / a) < 1e-9


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(states=st.lists(st.sampled_from("UDT"), min_size=1, max_size=40), n=st.integers(1, 4))
def test_debounce_equals_state_machine(spark, states, n):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(states)], "symbol string, ts int, regime string")
    current, pending, count, expected = "T", None, 0, []
    for s in states:
        pending, count = (s, count + 1) if s == pending else (s, 1)
        if s != current and count >= n:
            current = s
        expected.append(current)
    got = [r.confirmed for r in S.debounced(df, n).orderBy("ts").collect()]
    assert got == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.integers(1, 60), min_size=1, max_size=30))
def test_anchored_clusters_equal_scan(spark, xs):
    df = spark.createDataFrame([("a", float(x)) for x in xs], "symbol string, price double")
    anchors = []
    for x in sorted(xs):
        if not anchors or x - anchors[-1] > 5:
            anchors.append(x)
    got = {(r.price, r.anchor) for r in L.anchored_clusters(df, "x - a <= 5").collect()}
    assert got == {(float(x), float(max(a for a in anchors if a <= x))) for x in xs}


def test_upsert_and_klines(spark):
    old, new = spark.createDataFrame(walk(5), BAR), spark.createDataFrame([("a", T0, 1.0, 1.0, 1.0, 1.0, 9.0), ("b", T0, 1.0, 1.0, 1.0, 1.0, 1.0)], BAR)
    got = rows(B.upsert_keep_last(old, new), "symbol", "ts", "volume")
    assert len(got) == 6 and ("a", T0, 9.0) in got
    body = '[["1704067200000","1","2","0.5","1.5","7"],[1704067200000,9,9,9,9,9],["x",1],[1704070800000,1,2,0.5,"y",1]]'
    assert rows(B.klines(spark.createDataFrame([("a", body), ("b", None), ("c", "no")], "symbol string, body string"))) == [("a", T0, 1.0, 2.0, 0.5, 1.5, 7.0)]


def test_stop_wins_and_one_at_a_time(spark):
    bars = spark.createDataFrame([("a", T0 + dt.timedelta(days=i), 10.0, 12.0 if i == 2 else 10.5, 8.0 if i == 2 else 9.5, 10.0, 1.0) for i in range(6)], BAR)
    entries = spark.createDataFrame([("a", 0, 10.0, 11.0, 9.0), ("a", 1, 10.0, 11.0, 9.0), ("a", 2, 10.0, 11.0, 9.0)], "symbol string, entry_bar bigint, entry_price double, take_profit double, stop_loss double")
    hits = R.first_hits(entries, bars, 3)
    assert rows(hits, "entry_bar", "exit_bar", "exit_reason") == [(0, 2, "SL"), (1, 2, "SL"), (2, 5, "TIMEOUT")]
    assert rows(R.one_at_a_time(hits), "entry_bar") == [(0,), (2,)]


def test_rounding_and_texts(spark):
    df = spark.createDataFrame([(1e-7,), (0.0005,), (0.05,), (5.012,), (50.2,), (5003.0,), (60049.0,)], "x double")
    got = [tuple(r) for r in df.orderBy("x").select(Z.tiered_round(df.x, df.x), Z.display_grid(df.x), Z.round_number(df.x)).collect()]
    assert got[3:] == [(5.01, 5.0, 5.0), (50.2, 50.0, 50.25), (5003.0, 5005.0, 5000.0), (60049.0, 60000.0, 60000.0)]
    t = spark.createDataFrame([("buy at 65,000 USDT or $64,000.5\n- 70000 \nsupport near 60",), (None,), ("",)], "t string")
    assert [list(r[0]) for r in t.select(prices_in(t.t)).collect()] == [[60.0, 64000.5, 65000.0, 70000.0], [], []]


@pytest.mark.parametrize("text, day", [("2024-05-01", "2024-05-01"), (" 2024/05/01 ", "2024-05-01"), ("20240501", "2024-05-01"), ("1 May 2024", "2024-05-01"), ("2024-05-01T10:00:00+00:00", "2024-05-01"), ("2024-13-01", "None"), ("soon", "None"), ("", "None"), (None, "None")])
def test_days(spark, text, day):
    df = spark.createDataFrame([(text,)], "s string")
    assert str(df.select(day_of(df.s)).first()[0]) == day


def test_identifier_of_zeros(spark):
    df = spark.createDataFrame([("000",), ("{10E5AA19-1208-D7E5-DF18-6567531D673C}",), (" a-B",)], "s string")
    assert [r[0] for r in df.select(identifier_key(df.s)).collect()] == ["0", "10e5aa191208d7e5df186567531d673c", "a-b"]


def test_recurrences_in_blocks_are_those_of_one_pass(spark):
    import numpy as np

    from tidemark.operators.indicators import RECURRENT, recurrences, recurrent_indicators

    rng = np.random.default_rng(3)
    n = 9000
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    h, low = c * (1 + rng.random(n) * 0.01), c * (1 - rng.random(n) * 0.01)
    rows = [("s", dt.datetime(2020, 1, 1) + dt.timedelta(hours=k), float(h[k]), float(low[k]), float(c[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double")
    got = recurrent_indicators(df, block=1000).toPandas().sort_values("ts")
    want = recurrences(h, low, c)
    assert len(got) == n
    for name in RECURRENT:
        assert np.allclose(got[name].to_numpy(float), want[name], rtol=1e-9, atol=1e-9, equal_nan=True), name
