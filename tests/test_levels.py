import os

import numpy as np
import pytest

from tests.conftest import rows
from tidemark.operators import levels as L

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_ensemble_takes_all_five_methods(spark):
    from tidemark.plans import structure as P

    found = {r.method for r in P._all_levels(spark, FOLDER).select("method").distinct().collect()}
    assert {"market_structure", "volume_profile"} <= found  # these small tables have no flips
    methods = {m for r in P.ensemble_levels(spark, FOLDER).collect() for m in r.method.split("+")}
    assert "market_structure" in methods


def test_merged_levels_of_five_methods(spark):
    levels = [
        ("a", 100.0, 0.5, "market_structure", 2, 0.5, "HH_BOS", True), ("a", 100.1, 0.3, "market_structure", 1, 0.4, "LL_CHOCH", False), ("a", 100.2, 0.9, "volume_profile", 0, 0.0, "", False),
        ("a", 120.0, 0.6, "market_structure", 1, 0.2, "LH_BOS", False), ("a", 120.1, 0.2, "market_structure", 1, 0.9, "flipped_support", True),
    ]
    schema = "symbol string, price double, strength double, method string, touches bigint, recency double, role string, body boolean"
    got = rows(L.merged_levels(spark.createDataFrame(levels, schema), spark.createDataFrame([("a", 110.0)], "symbol string, last double")), "side", "strength", "method", "touches", "recency", "role")
    # 0.4 * (0.5 + 0.3) + 0.1 * 0.9 + 0.1 for the second method; 0.4 * (0.6 + 0.2)
    assert got == [("resistance", 0.32, "market_structure", 2, 0.9, "flipped_support"), ("support", 0.51, "market_structure+volume_profile", 3, 0.5, "LL_CHOCH")]


def spaced(points, least):
    """The fold over one symbol's swings as a plain loop."""
    kept, last = [], {"high": None, "low": None}
    for i, kind, price in points:
        other, up = ("low", price) if kind == "high" else ("high", -price)
        if last[other] is not None and abs(price - last[other]) < least:
            continue
        if last[kind] is not None and abs(price - last[kind]) < least:
            if up <= (last[kind] if kind == "high" else -last[kind]):
                continue
            kept = [p for p in kept if not (p[1] == kind and p[2] == last[kind])]
        kept.append((i, kind, price))
        last[kind] = price
    return kept


def test_wick_swings_are_spaced_by_the_range(spark):
    rng = np.random.default_rng(3)
    points = {
        # the second high replaces the first, the third is lower, the low is near the last high, the next one is not
        "a": [(3, "high", 10.0), (6, "high", 10.5), (9, "high", 10.2), (12, "low", 10.0), (15, "low", 8.0), (15, "high", 12.0), (18, "low", 7.5)],
        "b": [(k // 2, ("high", "low")[k % 2], float(p)) for k, p in enumerate(rng.integers(0, 60, 200) / 8)],
        "one": [(4, "low", 1.0)],
    }
    df = spark.createDataFrame([(s, i, 500, k, p) for s, v in points.items() for i, k, p in v], "symbol string, i bigint, n bigint, kind string, price double")
    for least in (1.0, 0.0):
        atr = spark.createDataFrame([(s, least) for s in points], "symbol string, atr double")
        got = rows(L.spaced_swings(df, atr), "symbol", "i", "kind", "price")
        assert got == sorted(((s, *p) for s, v in points.items() for p in (spaced(v, least) if least else v)), key=str)
    assert spaced(points["a"], 1.0) == [(6, "high", 10.5), (15, "high", 12.0), (18, "low", 7.5)]


def test_swings_leave_out_near_wicks(spark):
    """Two high wicks less than one range apart, far from all bodies: only the higher one stays."""
    bars = [("a", i, 10.0 + i % 2, 30.0 if i == 5 else 30.5 if i == 15 else 12.0, 9.0, 10.0 + i % 2, 1.0) for i in range(21)]
    df = spark.createDataFrame(bars, "symbol string, ts bigint, open double, high double, low double, close double, volume double")
    got = rows(L.swings(df, spark.createDataFrame([("a", 2.0)], "symbol string, atr double")).where("source = 'wick'"), "i", "kind", "price")
    assert got == [(15, "high", 30.5)]
