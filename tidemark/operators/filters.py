"""Entry filters: named predicates over a table of indicators, chains of them, and all their combinations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import indicators as I
from tidemark.operators.states import trend_regime, true

Predicate = Callable[[], Column]

# Each works on the columns of :func:`filter_inputs`; unknown values fail, except where a rule says otherwise.
FILTERS: dict[str, Predicate] = {
    "market_rsi_floor": lambda: F.col("market_rsi") >= 50,
    "rsi_momentum": lambda: F.col("rsi") > 60,
    "di_bullish": lambda: F.col("core_di_plus") > F.col("core_di_minus"),
    "adx_trend": lambda: F.col("core_adx") > 20,
    "band_place": lambda: F.col("pctb") < 0.80,
    "rsi_cap": lambda: F.col("rsi") <= 80,
    "relative_volume": lambda: F.col("known_volume").isNull() | (F.col("rvol") >= 1.5),
    "mid_regime": lambda: F.col("regime") != "D",
}


def filter_inputs(bars: DataFrame, market: str) -> DataFrame:
    """Indicators that the filters need, for each bar; ``market`` is the symbol whose RSI is the floor for all."""
    rows = trend_regime(I.rsi_simple(bars), 40, 20)
    mean = I.full(F.avg("volume").over(I.last(20)), 20)
    rows = rows.select("symbol", "ts", "close", "rsi", "regime", I.percent_b().alias("pctb"), I.relative_volume().alias("rvol"), F.when(mean > 0, mean).alias("known_volume"))
    rec = I.recurrent_indicators(bars, ["core_di_plus", "core_di_minus", "core_adx"]).drop("close")
    # one row a bar time: bounded by the calendar, joined by time
    floor = rows.where(F.col("symbol") == market).select("ts", F.col("rsi").alias("market_rsi"))
    return rows.join(rec, ["symbol", "ts"]).join(floor, "ts", "left")


def chain(df: DataFrame, names: Sequence[str | tuple[str, Column]]) -> DataFrame:
    """Adds ``passed``, ``failed`` (names of the filters that do not hold) and ``checks`` (each filter's verdict).

    A name that is not registered raises; own filters are given as (name, predicate).
    """
    pairs = [(n, FILTERS[n]()) if isinstance(n, str) else n for n in names]
    checks = F.array(*(F.struct(F.lit(n).alias("name"), true(p).alias("passed")) for n, p in pairs))
    out = df.withColumn("checks", checks)
    return out.withColumn("passed", F.forall("checks", lambda c: c["passed"])).withColumn("failed", F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"]))


def combinations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """For every subset of filters (a bit each) the number of rows that pass all of it.

    Rows are counted by the set of filters they pass first, so only those sets are expanded to their subsets.
    """
    mask = sum((F.when(true(FILTERS[n]()), F.lit(1 << k)).otherwise(F.lit(0)) for k, n in enumerate(names)), F.lit(0))
    sets = df.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))
    every = F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))
    subsets = sets.withColumn("combination", F.explode(F.filter(every, lambda c: c.bitwiseAND(F.col("mask")) == c)))
    return subsets.groupBy("combination").agg(F.sum("n").alias("passing"))


def folds(rows: DataFrame, warm_up_months: int = 6, test_months: int = 6, count: int = 3) -> DataFrame:
    """Adds ``fold`` from 1: test periods that follow a warm-up from the first row on; rows outside have none."""
    out = rows.sparkSession.sql("select *, (select min(ts) from {rows}) as __td_start from {rows}", rows=rows)
    month = F.floor(F.months_between("ts", F.col("__td_start")))
    fold = F.floor((month - warm_up_months) / test_months) + 1
    return out.withColumn("fold", F.when((fold >= 1) & (fold <= count), fold).cast("bigint")).drop("__td_start")
