"""Indicators over candle series: window forms for what has one, a grouped pass for true recurrences.

All windows are partitioned by symbol and ordered by time, so that one shuffle serves every indicator of a query.
A value is null, never NaN, while its window is not full, and comparisons with null count as false.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

def by() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def last(p: int) -> WindowSpec:
    return by().rowsBetween(1 - p, 0)


def full(value: Column, p: int) -> Column:
    """``value`` where the last ``p`` bars exist."""
    return F.when(F.count("*").over(last(p)) == p, value)


def sma(p: int, x: str | Column = "close") -> Column:
    return full(F.avg(x).over(last(p)), p)


def change(k: int = 1) -> Column:
    return F.try_divide("close", F.lag("close", k).over(by())) - 1


def true_range() -> Column:
    """High less low, or the wider distance to the previous close; the first bar has high less low."""
    before = F.lag("close").over(by())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def rsi_simple(bars: DataFrame, p: int = 10, name: str = "rsi") -> DataFrame:
    """RSI of mean gains and losses of the last ``p`` changes; 100 without losses; null before."""
    d = F.col("close") - F.lag("close").over(by())
    steps = bars.withColumn("__up", F.greatest(d, F.lit(0.0))).withColumn("__down", F.greatest(-d, F.lit(0.0)))
    up, down = F.avg("__up").over(last(p)), F.avg("__down").over(last(p))
    value = F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / down))
    return steps.withColumn(name, F.when(F.row_number().over(by()) > p, value)).drop("__up", "__down")


def atr_last(bars: DataFrame, p: int = 14) -> DataFrame:
    """Mean true range of each symbol's last ``p`` bars."""
    rows = bars.withColumn("tr", true_range()).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc())))
    return rows.where(F.col("r") <= p).groupBy("symbol").agg(F.avg("tr").alias("atr"))


def atr_series(bars: DataFrame, p: int = 14) -> DataFrame:
    """Rolling mean true range; the first ``p`` bars all have the mean of the first ``p``."""
    rows = bars.withColumn("__tr", true_range()).withColumn("__i", F.row_number().over(by()))
    head = F.avg(F.when(F.col("__i") <= p, F.col("__tr"))).over(Window.partitionBy("symbol"))
    return rows.withColumn("atr", F.when(F.col("__i") <= p, head).otherwise(F.avg("__tr").over(last(p)))).drop("__tr", "__i")


def relative_volume(p: int = 20) -> Column:
    """Volume over its mean of the last ``p`` bars, this one included; 1 where that is not known or zero."""
    mean = full(F.avg("volume").over(last(p)), p)
    return F.coalesce(F.when(mean > 0, F.col("volume") / mean), F.lit(1.0))


def percent_b(p: int = 20, width: float = 2.0) -> Column:
    """Place of the close between the Bollinger bands (population deviation)."""
    mid, dev = F.avg("close").over(last(p)), F.stddev_pop("close").over(last(p))
    return full(F.when(dev > 0, (F.col("close") - (mid - width * dev)) / (2 * width * dev)), p)


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def risk_features(bars: DataFrame) -> DataFrame:
    """Momentum over noise, short against long volatility, drawdown and volume by direction, each in -1..1."""
    seen = F.row_number().over(by())
    rows = bars.withColumn("__r", change()).withColumn("__d", F.col("close") - F.lag("close").over(by()))
    vol20, vol5 = F.stddev_samp("__r").over(last(20)), F.stddev_samp("__r").over(last(5))
    momentum = F.when((seen >= 22) & (vol20 > 0), clipped(change(20) / vol20 / 2.0))
    vol = F.when((seen >= 22) & (vol20 > 0), clipped((vol20 - vol5) / vol20))
    top = F.max("close").over(last(21))
    down = F.when((seen >= 21) & (top != 0), clipped(1 + (F.col("close") - top) / top / 0.20 * 2))
    up_vol, down_vol = (F.sum(F.when(c, F.col("volume")).otherwise(0.0)).over(last(19)) for c in (F.col("__d") > 0, F.col("__d") < 0))
    side = F.when((seen >= 21) & (up_vol + down_vol > 0), clipped((up_vol / (up_vol + down_vol) - 0.5) * 4))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("*", zero(momentum).alias("f_momentum"), zero(vol).alias("f_vol_regime"), zero(down).alias("f_drawdown"), zero(side).alias("f_dir_volume")).drop("__r", "__d")


def smoothed(x: np.ndarray, p: int, seed_at: int) -> np.ndarray:
    """y[i] = (y[i-1] * (p - 1) + x[i]) / p from the mean of the ``p`` values that end at ``seed_at``; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) > seed_at:
        y = out[seed_at] = x[seed_at - p + 1 : seed_at + 1].mean()
        for i, v in enumerate(x[seed_at + 1 :].tolist(), seed_at + 1):
            y = (y * (p - 1) + v) / p
            out[i] = y
    return out


def _ema(x: np.ndarray, span: int) -> np.ndarray:
    a, out = 2.0 / (span + 1), np.empty(len(x))
    y = x[0] if len(x) else 0.0
    for i, v in enumerate(x.tolist()):
        y = v if i == 0 else (1 - a) * y + a * v
        out[i] = y
    return out


def _strength(gain: np.ndarray, loss: np.ndarray, no_loss_ratio: float | None) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        rs = np.where(loss > 0, gain / loss, np.nan if no_loss_ratio is None else no_loss_ratio)
        out = 100 - 100 / (1 + rs)
    if no_loss_ratio is None:
        out = np.where(loss > 0, out, np.where(gain > 0, 100.0, 50.0))
    return np.where(np.isnan(gain), np.nan, out)


def _directional(tr, plus, minus, p: int, seed: int):
    """DI+, DI- and DX of smoothed movements; before the seed zero or, for DX only, missing."""
    atr, sp, sm = (smoothed(x, p, seed) for x in (tr, plus, minus))
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (np.where(atr > 0, 100 * x / atr, 0.0) for x in (sp, sm))
        dx = np.where(up + down > 0, 100 * np.abs(up - down) / (up + down), 0.0)
    return up, down, dx


def recurrences(high: np.ndarray, low: np.ndarray, close: np.ndarray, p: int = 14, rsi: int = 8, rsi_long: int = 10) -> dict[str, np.ndarray]:
    """Every smoothed indicator of one series, bar by bar.

    The three directional variants differ in their seeds: ``core`` from bars 1 to p with DX averaged for the
    first ADX, ``regime`` and ``roro`` with DX taken as zero before the seed, ``roro`` counting bar 0 as well.
    """
    n = len(close)
    before = np.concatenate([close[:1], close[:-1]])
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    up = np.concatenate([[0.0], np.diff(high)]) if n else high
    down = np.concatenate([[0.0], -np.diff(low)]) if n else low
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    step = np.concatenate([[0.0], np.diff(close)]) if n else close
    gain, loss = np.maximum(step, 0.0), np.maximum(-step, 0.0)
    if n:
        tr[0] = 0.0
    out = {"ema_12": _ema(close, 12), "ema_26": _ema(close, 26)}
    pdi, mdi, dx = _directional(tr, plus, minus, p, p)
    out |= {"core_di_plus": np.where(np.isnan(pdi), 0.0, pdi), "core_di_minus": np.where(np.isnan(mdi), 0.0, mdi)}
    adx = smoothed(np.nan_to_num(dx), p, 2 * p)
    out["core_adx"] = np.nan_to_num(adx)
    # counted from bar 1: the first ADX is DX of the seed bar over p
    r = {k: np.full(n, np.nan) for k in ("di_plus", "di_minus", "adx")}
    if n > p:
        r["di_plus"], r["di_minus"] = pdi, mdi
        r["adx"] = smoothed(np.concatenate([[0.0], np.where(np.arange(1, n) < p, 0.0, np.nan_to_num(dx[1:]))]), p, p)
    out |= {f"regime_{k}": v for k, v in r.items()}
    out["regime_rsi"] = _strength(*(smoothed(x[1:], rsi, rsi - 1) for x in (gain, loss)), 100.0) if n > 1 else np.full(n, np.nan)
    out["regime_rsi"] = np.concatenate([[np.nan], out["regime_rsi"]])[:n] if n > 1 else out["regime_rsi"]
    if n > rsi:
        out["regime_rsi"][rsi] = np.nan  # the first value comes after one update
    pdi, mdi, dx = _directional(tr, plus, minus, p, p - 1)
    out |= {"roro_di_plus": np.nan_to_num(pdi), "roro_di_minus": np.nan_to_num(mdi)}
    out["roro_adx"] = smoothed(np.nan_to_num(dx), p, p - 1)
    out["roro_rsi"] = _strength(smoothed(gain, rsi, rsi - 1), smoothed(loss, rsi, rsi - 1), None)
    g, s = smoothed(gain, rsi_long, rsi_long - 1), smoothed(loss, rsi_long, rsi_long - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["rsi_wilder"] = np.where(s > 0, 100 - 100 / (1 + g / s), np.where(g > 0, 100.0, np.nan))
    return out


RECURRENT = (
    "ema_12 ema_26 core_di_plus core_di_minus core_adx regime_di_plus regime_di_minus regime_adx regime_rsi roro_di_plus roro_di_minus roro_adx roro_rsi rsi_wilder".split()
)


def recurrent_indicators(bars: DataFrame, columns: Sequence[str] = tuple(RECURRENT), block: int = 8192, before: int = 2048) -> DataFrame:
    """``symbol, ts, close`` and the chosen recurrences.

    A symbol's bars are worked on in blocks of ``block``, each after the ``before`` bars that precede it, so a hot symbol
    is spread over all tasks. What lies further back weighs less than a double can show: a smoothing keeps at most 25/27
    of it a bar, 1e-68 over 2048 bars, and ADX, which smooths twice, is as exact.
    """
    columns = list(columns)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        found = recurrences(*(pdf[c].to_numpy(float) for c in ("high", "low", "close")))
        own = (pdf["i"] // block == key[1]).to_numpy()
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "ts": pdf["ts"].to_numpy(), "close": pdf["close"].to_numpy()} | {c: found[c] for c in columns})[own]

    kind = bars.schema["ts"].dataType.simpleString()
    schema = f"symbol string, ts {kind}, close double, " + ", ".join(f"{c} double" for c in columns)
    numbered = bars.select("symbol", "ts", "high", "low", "close", (F.row_number().over(by()) - 1).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    following = F.least(F.expr(f"(i + {before}) div {block}"), F.expr(f"(n - 1) div {block}"))
    blocks = numbered.withColumn("b", F.explode(F.sequence(F.expr(f"i div {block}"), following))).drop("n")
    rows = blocks.groupBy("symbol", "b").applyInPandas(run, schema)
    return rows.select("symbol", "ts", "close", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns))
