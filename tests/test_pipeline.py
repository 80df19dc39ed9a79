"""The order-dependent rules of the zone pipeline on small levels, and the same through Spark."""

import datetime as dt
import json

import pytest

from tidemark.operators import pipeline as P
from tidemark.operators.pipeline import Rules, Zone, across_windows, rounded_to, tier_round, zones_of


def level(price, side, kind="window", strength=0.3, method="touch_count", touches=3, role="", wick=True, snap=None, age=0.0, confirmed=False):
    return dict(kind=kind, price=price, side=side, strength=strength, method=method, touches=touches, role=role, wick=wick, anchor=price, snap=snap or 0.0, age=age, confirmed=confirmed)


def zone(mid, side="support", tier="Minor", methods=1, touches=3, role="", confirmed=False):
    return Zone(side, mid, mid, tier, methods, touches, confirmed, role, "", 0.0)


def test_across_windows():
    first, second = (Rules(v, 200.0, 5.0, 0.0) for v in (False, True))
    chain = [level(100.0, "support", touches=1), level(101.5, "support", touches=5), level(103.0, "support", touches=2), level(101.0, "resistance")]
    # first variant: the place moves to 101.5, so 103 is still within two percent of it
    assert [(x["price"], x["side"]) for x in across_windows(chain, first)] == [(101.5, "support"), (101.0, "resistance")]
    # second variant: within 0.4 * 5 of the first one, which stays the place
    assert [(x["price"], x["side"]) for x in across_windows(chain, second)] == [(101.5, "support"), (101.0, "resistance"), (103.0, "support")]
    turned = level(101.0, "support", role="HL_CHOCH", touches=1)
    assert across_windows([level(100.0, "support", touches=50), turned], second) == [turned]
    assert across_windows([], first) == []


def test_zone_of_a_level():
    r = Rules(False, 100.0, 2.0, -1.0)
    z = r.zone(level(99.98, "support", method="a+b", touches=1))
    assert (z.side, z.key, z.mid, z.tier, z.methods) == ("support", 100.0, 100.0, "Major", 2)
    # a key on the wrong side gives way to the price, and the price to the other side
    assert r.zone(level(101.3, "support")).side == "resistance" and r.zone(level(97.2, "resistance")).side == "support"
    # a falling structure favours touched resistances
    assert r.zone(level(110.0, "resistance", touches=10)).tier == "Major" and r.zone(level(90.0, "support", touches=10)).tier == "Minor"
    assert r.zone(level(90.0, "support", role="flipped_support")).tier == "Major" and r.zone(level(90.0, "support", touches=25)).tier == "Major"
    s = Rules(True, 100.0, 2.0, 0.0)
    assert s.zone(level(90.0, "support", snap=89.0)).key == 89.0 and s.zone(level(90.0, "support", touches=25)).tier == "Minor"


def test_merging_and_sandwiched():
    r = Rules(False, 150.0, 2.0, 0.0)
    got = r.merged([zone(100.0, touches=2, methods=3, role="HH_CHOCH"), zone(101.9, touches=9), zone(103.8, touches=1, confirmed=True), zone(110.0)])
    assert [(z.mid, z.touches, z.methods, z.confirmed, z.role) for z in got] == [(101.9, 12, 3, True, "HH_CHOCH"), (110.0, 3, 1, False, "")]
    zones = [zone(100.0, tier="Major"), zone(101.5), zone(103.0, tier="Major"), zone(106.0)]
    assert [z.mid for z in r.unsandwiched(zones)] == [100.0, 103.0, 106.0]
    assert r.unsandwiched(zones[:2]) == zones[:2]


@pytest.mark.parametrize("second", [False, True])
def test_whole_pipeline(second):
    levels = [level(p, "support" if p < 1000 else "resistance", touches=int(p) % 7 + 1, method="a+b" if p % 2 else "a") for p in range(700, 1300, 23)]
    levels += [level(880.0, "support", kind="poc", strength=0.45, touches=0), level(1095.0, "resistance", kind="sma_50", strength=0.35, touches=0), level(1500.0, "resistance")]
    got = zones_of(levels, 1000.0, 12.0, 0.0, second)
    for side in ("support", "resistance"):
        own = [z for z in got if z.side == side]
        assert 1 <= len(own) <= 3 and [abs(z.mid - 1000) for z in own] == sorted(abs(z.mid - 1000) for z in own)
        assert all((z.key < 1000) == (side == "support") for z in own)
    assert all(abs(z.mid - 1000) <= 300 for z in got)
    if second:
        assert all(abs(a.mid - b.mid) >= 9 for a in got for b in got if a is not b and a.side == b.side)
    supports, resistances = ([z.mid for z in got if z.side == s] for s in ("support", "resistance"))
    assert all(abs(s - r) / s >= 0.02 for s in supports for r in resistances) or second
    assert zones_of([], 1000.0, 12.0, 0.0, second) == []


def test_guarantees_and_backfill():
    poc, mean = level(95.0, "support", kind="poc", touches=0), level(106.0, "resistance", kind="sma_100", touches=0)
    got = zones_of([poc, mean, level(70.5, "support", kind="full"), level(45.0, "support", kind="full"), level(80.0, "support", kind="full", strength=0.05, touches=1)], 100.0, 2.0, 0.0)
    # the point of control and the mean are there; 70.5 is filled in, 45 is too far, 80 too weak
    assert [(z.side, z.mid) for z in got] == [("support", 95.0), ("support", 70.5), ("resistance", 106.0)]
    assert got[-1].note == "SMA 100"


def test_numbers():
    assert rounded_to(99.9) == 100.0 and rounded_to(97.7) == 97.5 and rounded_to(1001.0) == 1000.0 and rounded_to(333.3) == 333.3
    assert tier_round(1234.5678, 1234.0) == 1235 and tier_round(0.123456, 0.12) == 0.1235


def test_scenarios():
    supports = [zone(99.0), zone(95.0), zone(90.0)]
    above = [zone(101.0, "resistance", "Major"), zone(108.0, "resistance", "Major"), zone(115.0, "resistance")]
    got = P.scenarios(supports + above, 100.0, 5.0)
    # 99 and 101 are nearer than two percent, so 95 must hold and 108 is the target
    assert got["bullish"] == {"hold_above": 95.0, "next_target": 108.0, "invalidation": 90.0}
    assert got["bearish"] == {"fails_at": 95.0, "retests": 90.0, "reopens": 89.0}
    assert got["triggers"] == {"buy_the_dip": 95.0, "stop_loss": 89.0, "take_profit": 108.0}
    far = P.scenarios([zone(95.0), zone(103.0, "resistance"), zone(120.0, "resistance", "Major")], 100.0, 5.0)
    assert far["bullish"] == {"hold_above": 95.0, "next_target": 103.0, "extended_target": 120.0, "invalidation": 94.0} and far["bearish"] == {"fails_at": 95.0}
    assert P.scenarios([], 100.0, 5.0) == {"bullish": {}, "bearish": {}, "triggers": {}}


def test_through_spark(spark):
    start = dt.datetime(2024, 1, 1)
    bars = [(s, start + dt.timedelta(days=k), 100.0 + k % 7, 103.0 + k % 7, 99.0 + k % 7, 101.0 + k % 7, 10.0 + k % 5) for s in "ab" for k in range(60)]
    bars = spark.createDataFrame(bars, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    atr = bars.selectExpr("symbol").distinct().selectExpr("symbol", "3.0D as atr")
    outlook = bars.groupBy("symbol").count().selectExpr("symbol", "104.0D as last", "0.0D as bias", "98.0D as sma_50", "cast(null as double) as sma_100", "cast(null as double) as sma_200")
    area = outlook.selectExpr("symbol", "101.5D as poc")
    rows = [("a", p, s, 0.3, m, t, r, True, None, 0.0) for p, s, m, t, r in ((97.0, "support", "x+y", 4, ""), (92.0, "support", "x", None, None), (110.0, "resistance", "x", 30, "HH_BOS"), (117.0, "resistance", "x", 2, "LH_CHOCH"))]
    found = spark.createDataFrame(rows, "symbol string, price double, side string, strength double, method string, touches bigint, role string, wick boolean, snap double, age double")
    levels = P.candidates(found, found.limit(0), outlook, area)
    got = {(r.symbol, r.side, r.place): r.price for r in P.zones(levels, bars, atr, outlook).collect()}
    assert got["a", "resistance", 1] == 110.0 and got["a", "resistance", 2] == 117.0
    # symbol b has no levels of its own: the point of control and the mean of 50 bars are its zones
    assert {k: v for k, v in got.items() if k[0] == "b"} and all(k[1] == "support" for k in got if k[0] == "b")
    assert P.zones(levels.limit(0), bars, atr, outlook).collect() == []
    more = outlook.selectExpr("*", "60L as bars", "'Bullish' as trend", "'Undefined' as structure")
    docs = {r.symbol: json.loads(r.document) for r in P.documents(P.zones(levels, bars, atr, outlook), more, atr, area.selectExpr("*", "100.0D as low", "103.0D as high")).collect()}
    assert docs["a"]["resistance"][0]["key_level"] == 110 and docs["b"]["resistance"] == [] and docs["b"]["volume_profile"]["value_area_low"] == 100.0
    assert P.documents(P.zones(levels.limit(0), bars, atr, outlook), more, atr, area.selectExpr("*", "100.0D as low", "103.0D as high")).count() == 2
