"""Plans of several steps: no definition of a WITH may lie in one plan twice, as the optimizer mixes such copies up."""

import datetime as dt
import re

import pytest

from tests.conftest import rows
from tidemark.operators import levels as L, zones as Z


@pytest.fixture(scope="module")
def bars(spark):
    start = dt.datetime(2024, 1, 1)
    wave = [abs(k % 16 - 8) for k in range(96)]
    found = [(s, start + dt.timedelta(hours=k), 100.0 + w, 101.5 + w, 99.0 + w, 100.5 + w, 10.0 + k % 3) for s in "ab" for k, w in enumerate(wave)]
    return spark.createDataFrame(found, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def atr(bars):
    return bars.selectExpr("symbol", "2.0D as atr").distinct()


def repeated(df):
    ids = re.findall(r"CTERelationDef (\d+)", df._jdf.queryExecution().analyzed().toString())
    return sorted({i for i in ids if ids.count(i) > 1})


def zones_of(bars, atr):
    levels = L.touch_levels(bars).select("symbol", "price", "side", "strength", "touches", "recency")
    return Z.scored(Z.volume_confirmed(levels, bars, atr))


def test_cross_side(spark, bars, atr):
    got = Z.cross_side(zones_of(bars, atr))
    assert repeated(got) == []
    left = rows(got, "symbol", "price", "side", "score")
    assert left and [(p, side, score) for s, p, side, score in left if s == "a"] == [(p, side, score) for s, p, side, score in left if s == "b"]
    near = spark.createDataFrame([("a", 100.0, "support", 5.0), ("a", 101.0, "resistance", 5.0), ("a", 101.5, "resistance", 6.0), ("b", 100.0, "support", 5.0), ("b", 103.0, "resistance", 9.0)], "symbol string, price double, side string, score double")
    assert rows(Z.cross_side(near), "symbol", "price") == [("a", 101.5), ("b", 100.0), ("b", 103.0)]


def test_body_anchors(spark, bars, atr):
    got = Z.body_anchors(zones_of(bars, atr).select("symbol", "price", "side"), bars, atr.withColumn("atr", atr["atr"] / 8))
    assert repeated(got) == [] and got.count() == zones_of(bars, atr).count()
    near = spark.createDataFrame([("a", 100.1, "support"), ("a", 150.0, "support")], "symbol string, price double, side string")
    found = rows(Z.body_anchors(near, bars, atr.withColumn("atr", atr["atr"] / 8)), "price", "anchor", "anchor_type")
    assert found == [(100.1, 100.0, "Body"), (150.0, 150.0, "Stat")]
    low = spark.createDataFrame([("z", dt.datetime(2024, 1, 1, k), 5.0 - 4 * (k == 1), 9.0, 0.5, 5.0, 1.0) for k in range(3)], bars.schema)
    zero = spark.createDataFrame([("z", 0.0, "support")], "symbol string, price double, side string")
    assert rows(Z.body_anchors(zero, low, spark.createDataFrame([("z", 3.0)], "symbol string, atr double")), "anchor", "snap_pct") == [(1.0, float("inf"))]


def test_structure_levels(bars, atr):
    points = L.swings(bars, atr)
    got = L.structure_levels(L.swing_roles(points), L.break_counts(points, bars, atr))
    assert repeated(got) == []
    # the low at bar 88, the last one, is shielded and has no breaks
    left = rows(got.where("bar = 88 and source = 'body'"), "symbol", "price", "side", "flipped", "touches")
    assert left == [(s, 100.0, "support", False, 1) for s in "ab"]
