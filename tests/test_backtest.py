"""The book over all symbols against a plain loop."""

import datetime as dt
import random

import pytest

from tidemark.operators.backtest import pooled

T0 = dt.datetime(2024, 1, 1)


def replay(signals, bars, hold, slots, pause):
    """Bar by bar: positions with their exit time, ranked entries at the next open."""
    by = {s: [b for b in bars if b[0] == s] for s in {b[0] for b in bars}}
    at = {s: {b[1]: k for k, b in enumerate(own)} for s, own in by.items()}
    held, left, out = {}, {}, []
    for s, ts, rank, tp, sl in sorted(signals, key=lambda x: (x[1], -x[2], x[0])):
        own, k = by[s], at[s][ts]
        if k + 1 >= len(own):
            continue
        for name in [n for n, leave in held.items() if leave <= ts]:
            left[name] = held.pop(name)
        if s in held or len(held) >= slots or s in left and (left[s] == ts or ts - left[s] < pause):
            continue
        window = own[k + 1 : k + 1 + hold]
        leave, price, reason = window[-1][1], window[-1][5], "TIMEOUT" if len(window) == hold else "OPEN"
        for b in window:
            if b[4] <= sl or b[3] >= tp:
                leave, price, reason = b[1], sl if b[4] <= sl else tp, "SL" if b[4] <= sl else "TP"
                break
        held[s] = leave
        out.append((s, ts, window[0][1], window[0][2], leave, price, reason))
    return out


@pytest.mark.parametrize("hold, slots, hours", [(5, 1, 0), (7, 2, 0), (10, 2, 24)])
def test_pooled(spark, hold, slots, hours):
    rng = random.Random(hold)
    bars, signals = [], []
    for s in "abc":
        p = 100.0
        for k in range(120):
            o = p
            p *= 1 + rng.uniform(-0.02, 0.02)
            bars.append((s, T0 + dt.timedelta(hours=k), o, max(o, p) * 1.003, min(o, p) * 0.997, p, 1.0))
            if rng.random() < 0.4:
                signals.append((s, T0 + dt.timedelta(hours=k), round(rng.random(), 6), p * 1.02, p * 0.98))
    b = spark.createDataFrame(bars, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    s = spark.createDataFrame([("x", *r) for r in signals], "strategy string, symbol string, ts timestamp, rank double, take_profit double, stop_loss double")
    got = [(r.symbol, r.signal_ts, r.entry_ts, r.entry_price, r.exit_ts, r.exit_price, r.exit_reason) for r in pooled(s, b, hold, slots, hours).collect()]
    assert sorted(got) == sorted(replay(signals, bars, hold, slots, dt.timedelta(hours=hours)))
