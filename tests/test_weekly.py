import datetime as dt

from tidemark.operators import weekly as K

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def weeks(symbol, closes):
    opens = [(a + b) / 2 for a, b in zip(closes[:1] + closes[:-1], closes)]
    return [(symbol, T0 + dt.timedelta(weeks=i), o, max(o, c), min(o, c), c, 1.0) for i, (o, c) in enumerate(zip(opens, closes))]


def test_stale_pivots_strength_and_weeks(spark):
    swing = [100.0, 104.0, 110.0, 105.0, 101.0, 97.0, 99.0, 103.0, 107.0, 104.0, 100.0, 96.0, 98.0, 101.0]
    bars = weeks("falling", swing + [95.0 - 4 * i for i in range(12)]) + weeks("rising", swing + [104.0 + 5 * i for i in range(12)]) + weeks("still", swing + [101.0 + 0.1 * i for i in range(6)])
    got = {r.symbol: r for r in K.structure(spark.createDataFrame(bars, BAR)).collect()}
    pivots = {(r.symbol, r.kind): r for r in K.pivots(spark.createDataFrame(bars, BAR)).orderBy("i").collect()}
    # the last close is the lowest body of the last six weeks, so it is the low, and it breaks nothing
    f = got["falling"]
    assert pivots["falling", "low"].price > 90 and (f.last_low, f.signal, f.strength, f.weeks_in_state) == (51.0, "NONE", 0, 0)
    assert f.sequence.endswith("LL")
    r = got["rising"]
    assert pivots["rising", "high"].price < 111 and (r.last_high, r.signal, r.weeks_in_state) == (159.0, "NONE", 0)
    assert r.sequence.startswith("HH")
    s = got["still"]
    on = max(pivots["still", k].confirmed_on for k in ("high", "low"))
    assert s.last_high == pivots["still", "high"].price and s.weeks_in_state == (s.as_of - on).days // 7 > 0


def test_strength_of_a_break(spark):
    swing = [100.0, 104.0, 110.0, 105.0, 101.0, 97.0, 99.0, 103.0, 107.0, 104.0, 100.0, 96.0, 98.0, 101.0, 102.0, 103.0]
    bars = weeks("far", swing + [115.0]) + weeks("near", swing + [106.9, 107.5])
    got = {r.symbol: (r.signal, r.strength) for r in K.structure(spark.createDataFrame(bars, BAR)).collect()}
    # two highs (110, 107) and lows (97, 96): CHOCH against the falling sequence
    assert got == {"far": ("CHOCH_UP", 3), "near": ("CHOCH_UP", 1)}


def test_apart_pivots_against_a_plain_loop(spark):
    import random

    from tidemark.operators.weekly import apart_pivots

    rng = random.Random(4)
    data, expected = [], []
    for symbol in "ab":
        price, own = 100.0, []
        for i in range(60):
            price *= 1 + rng.uniform(-0.03, 0.03)
            own.append((symbol, i, rng.choice(("high", "low")), round(price, 4), dt.datetime(2024, 1, 1) + dt.timedelta(weeks=i)))
        data += own
        kept, last = [], {}
        for p in own:
            before = last.get(p[2])
            if before is None or abs(p[3] - before[3]) / before[3] >= 0.02:
                kept.append(p)
                last[p[2]] = p
            elif p[3] > before[3] if p[2] == "high" else p[3] < before[3]:
                kept = [x for x in kept if x is not before] + [p]
                last[p[2]] = p
        expected += kept
    rng.shuffle(data)
    df = spark.createDataFrame(data, "symbol string, i bigint, kind string, price double, confirmed_on timestamp")
    got = [tuple(r) for r in apart_pivots(df, 0.02).select("symbol", "i", "kind", "price").collect()]
    assert sorted(got) == sorted(p[:4] for p in expected) and len(got) < len(data)
    assert apart_pivots(df.limit(0), 0.02).collect() == []


def test_states_with_what_was_known(spark):
    from tidemark.operators.weekly import states

    start = dt.datetime(2023, 1, 2)
    closes = [10, 12, 15, 13, 11, 13, 17, 15, 13, 15, 19, 17, 15, 17, 21, 19, 17, 18, 14, 9]
    bars = [("a", start + dt.timedelta(weeks=k), float(c), c + 0.5, c - 0.5, float(c), 1.0) for k, c in enumerate(closes)] + [("b", start, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(bars, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "symbol string")
    first = {r.symbol: r for r in states(asked, df).collect()}
    assert first["a"].state == "BULLISH" and first["a"].signal == "CHOCH_DOWN" and first["a"].strength >= 2
    assert (first["b"].state, first["b"].error) == ("INSUFFICIENT_DATA", "only 1 closed weeks, 16 needed") and first["c"].state == "UNKNOWN" and len(first) == 3
    for prior, state, signal in (("BULLISH", "BEARISH", "CHOCH_DOWN"), ("RANGING", "BEARISH", "BOS_DOWN"), ("TRANSITIONING", "TRANSITIONING", "CHOCH_DOWN"), ("BEARISH", "BEARISH", "BOS_DOWN")):
        known = spark.createDataFrame([("a", prior, 1)], "symbol string, prior string, weeks_without_break int")
        got = {r.symbol: r for r in states(asked, df, known).collect()}["a"]
        assert (got.state, got.signal) == (state, signal), prior
