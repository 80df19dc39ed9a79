"""Regimes and other states over candle series, in window form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.operators import indicators as I
from tidemark.operators.sizing import small


def upto() -> WindowSpec:
    return I.by().rowsBetween(Window.unboundedPreceding, 0)


def true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def trend_regime(bars: DataFrame, period: int, slope: int, name: str = "regime") -> DataFrame:
    """U where the close is above its mean and the mean rises, D where neither holds, else T.

    Unknown comparisons count as false, so bars before the windows are full are D.
    """
    rows = bars.withColumn("__m", I.sma(period))
    above, rising = true(F.col("close") > F.col("__m")), true(F.col("__m") > F.lag("__m", slope).over(I.by()))
    return rows.withColumn(name, F.when(above & rising, "U").when(~above & ~rising, "D").otherwise("T")).drop("__m")


def debounced(states: DataFrame, bars: int, state: str = "regime", start: str = "T", name: str = "confirmed") -> DataFrame:
    """The last state that held for ``bars`` bars in a row; ``start`` before there is one."""
    changed = F.coalesce((F.col(state) != F.lag(state).over(I.by())).cast("int"), F.lit(0))
    runs = states.withColumn("__c", changed).withColumn("__run", F.sum("__c").over(upto()))
    place = F.row_number().over(Window.partitionBy("symbol", "__run").orderBy("ts"))
    held = runs.withColumn("__k", place)
    out = F.last(F.when(F.col("__k") >= bars, F.col(state)), ignorenulls=True).over(upto())
    return held.withColumn(name, F.coalesce(out, F.lit(start))).drop("__c", "__run", "__k")


def hysteresis(rows: DataFrame, value: str, on_above: float, off_below: float, name: str = "on") -> DataFrame:
    """On above one threshold, off below the other, unchanged in between; off at first. Needs off <= on."""
    switch = F.when(F.col(value) > on_above, True).when(F.col(value) < off_below, False)
    return rows.withColumn(name, F.coalesce(F.last(switch, ignorenulls=True).over(upto()), F.lit(False)))


# Periods, slopes and confirmation bars of the long, middle and short view.
TIMEFRAMES = {"long_term": (100, 20, 1), "mid_term": (50, 10, 1), "short_term": (20, 5, 1)}


def three_timeframes(bars: DataFrame, timeframes: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Confirmed regime on three views and their key such as U/T/D, for a join with a table of gates."""
    frames = timeframes or TIMEFRAMES
    out = bars
    for name, (period, slope, confirm) in frames.items():
        out = debounced(trend_regime(out, period, slope, "__raw"), confirm, "__raw", "T", name).drop("__raw")
    return out.withColumn("gate_key", F.concat_ws("/", *frames))


def gated(states: DataFrame, gates: DataFrame) -> DataFrame:
    """Adds ``gate`` from a table ``gate_key, gate`` of any length; false for keys that it has not.

    A key with several rows is open only if all of them are; a null gate is shut, and null keys match nothing.
    """
    table = gates.groupBy("gate_key").agg(F.bool_and(true(F.col("gate"))).alias("gate"))
    return states.join(small(table, gates), "gate_key", "left").withColumn("gate", true(F.col("gate")))


# Thresholds of the directional regime.
TREND_ADX, RANGE_ADX, DI_GAP, BULL_RSI, BEAR_RSI = 28.92, 19.02, 5.47, 56.40, 48.08


def classified(bars: DataFrame) -> DataFrame:
    """Directional regime of every bar with ``regime_adx``; null before."""
    rows = I.recurrent_indicators(bars, ["regime_di_plus", "regime_di_minus", "regime_adx", "regime_rsi"])
    gap = F.col("regime_di_plus") - F.col("regime_di_minus")
    trending = F.col("regime_adx") >= TREND_ADX
    wide = F.abs(gap) >= DI_GAP
    label = (
        F.when(trending & wide & (gap > 0) & (F.col("regime_rsi") > BULL_RSI), "BULL")
        .when(trending & wide & (gap < 0) & (F.col("regime_rsi") < BEAR_RSI), "BEAR")
        .when(trending, "NEUTRAL")
        .when(F.col("regime_adx") > RANGE_ADX, "TRANSITION")
        .when(F.col("regime_adx") <= RANGE_ADX, "RANGE")
    )
    return rows.withColumn("regime", label)


def regime_confidence(bars: DataFrame, back: int = 3) -> DataFrame:
    """:func:`classified` with ``adx_slope`` and ``di_slope`` (change over ``back`` bars), their directions and ``confidence``.

    A bar without ADX is UNDEFINED. Confidence grows with the distance from the thresholds and, in trends, with a rising
    ADX; it lies between 0 and 1.
    """
    rows = classified(bars).withColumn("regime", F.coalesce("regime", F.lit("UNDEFINED")))
    spread = F.col("regime_di_plus") - F.col("regime_di_minus")
    change = lambda x: F.coalesce(x - F.lag(x, back).over(I.by()), F.lit(0.0))
    rows = rows.withColumn("adx_slope", change(F.col("regime_adx"))).withColumn("di_slope", change(F.coalesce(spread, F.lit(0.0))))
    adx, gap = F.col("regime_adx"), F.abs(spread)
    trending = F.col("regime").isin("BULL", "BEAR")
    base = (
        F.when(trending, (F.least(adx / TREND_ADX, F.lit(1.5)) / 1.5 + F.least(gap / DI_GAP, F.lit(1.5)) / 1.5) / 2)
        .when(F.col("regime") == "NEUTRAL", F.least(adx / TREND_ADX, F.lit(1.0)) * 0.5)
        .when(F.col("regime") == "TRANSITION", 0.4 + (adx - RANGE_ADX) / max(TREND_ADX - RANGE_ADX, 1) * 0.2)
        .when(F.col("regime") == "RANGE", F.greatest(1.0 - adx / max(RANGE_ADX, 1), F.lit(0.1)))
        .otherwise(F.lit(0.1))
    )
    lift = F.greatest(F.least(F.col("adx_slope") * 0.05, F.lit(0.15)), F.lit(-0.15))
    moved = F.when(trending, base + lift).when(F.col("regime") == "RANGE", base - lift).otherwise(base)
    direction = lambda c: F.when(F.col(c) > 0.5, "up").when(F.col(c) < -0.5, "down").otherwise("flat")
    return rows.withColumn("confidence", F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).withColumn("adx_direction", direction("adx_slope")).withColumn("di_direction", direction("di_slope"))


def risk_composite(bars: DataFrame) -> DataFrame:
    """The seven risk features of every bar, how many are positive, their mean and the vote.

    Where high, low and close have been the same so far, the two directional features do not count.
    """
    base = I.risk_features(bars)
    rec = I.recurrent_indicators(bars, ["ema_12", "ema_26", "roro_adx", "roro_di_plus", "roro_di_minus"]).drop("close")
    rows = base.join(rec, ["symbol", "ts"])
    seen = F.row_number().over(I.by())
    flat = F.min((F.col("high") == F.col("low")).cast("int")).over(upto()) == 1
    rows = rows.withColumn("__seen", seen).withColumn("__flat", flat)
    ready = F.col("__seen") >= 42
    trend = F.when((F.col("__seen") >= 31) & (F.col("ema_26") != 0), I.clipped((F.col("ema_12") - F.col("ema_26")) / F.col("ema_26") / 0.05)).otherwise(F.lit(0.0))
    adx = I.clipped((F.when(ready, F.coalesce("roro_adx", F.lit(25.0))).otherwise(F.lit(25.0)) - 25) / 25)
    spread = I.clipped(F.when(ready, F.col("roro_di_plus") - F.col("roro_di_minus")).otherwise(F.lit(0.0)) / 30)
    rows = rows.withColumn("f_trend", trend).withColumn("f_adx_strength", adx).withColumn("f_di_spread", spread)
    common = ["f_trend", "f_momentum", "f_vol_regime", "f_drawdown", "f_dir_volume"]
    directional = ["f_adx_strength", "f_di_spread"]
    votes = sum((F.col(c) > 0).cast("int") for c in common) + F.when(F.col("__flat"), 0).otherwise(sum((F.col(c) > 0).cast("int") for c in directional))
    total = sum(F.col(c) for c in common) + F.when(F.col("__flat"), 0.0).otherwise(sum(F.col(c) for c in directional))
    size = F.when(F.col("__flat"), 5).otherwise(7)
    return rows.select(
        "symbol", "ts", *common, *directional, votes.cast("bigint").alias("n_positive"), (total / size).alias("roro_composite"), (votes >= 4).alias("vote_4")
    )
