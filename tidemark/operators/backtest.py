"""Replays of entries on candle series, and statistics of the trades they give."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.levels import _numbered, _sql

TRADE = "symbol string, entry_bar bigint, entry_price double, take_profit double, stop_loss double, exit_bar bigint, exit_price double, exit_reason string"


def first_hits(entries: DataFrame, bars: DataFrame, hold: int = 7) -> DataFrame:
    """Exit of every entry ``symbol, entry_bar, entry_price, take_profit, stop_loss``: the first later bar that reaches
    the stop or the target (the stop where a bar reaches both), at the latest after ``hold`` bars at the close.

    Entries meet exactly the bars they look at, by symbol and bar number, so no symbol is hot."""
    return _sql(
        f"""with p as (select *, explode(sequence(entry_bar + 1, entry_bar + {hold})) as at from {{entries}}),
            h as (select p.*, b.i, b.n, b.close, b.low <= p.stop_loss as stopped, b.high >= p.take_profit as reached from p join {{bars}} b on b.symbol = p.symbol and b.i = p.at),
            x as (select symbol, entry_bar, entry_price, take_profit, stop_loss, min_by(struct(i, stopped, reached, close), if(stopped or reached, i, null)) as hit, max_by(struct(i, close), i) as final
              from h group by symbol, entry_bar, entry_price, take_profit, stop_loss)
            select symbol, entry_bar, entry_price, take_profit, stop_loss, coalesce(hit.i, final.i) as exit_bar,
              case when hit.stopped then stop_loss when hit.reached then take_profit else final.close end as exit_price,
              case when hit.stopped then 'SL' when hit.reached then 'TP' else 'TIMEOUT' end as exit_reason from x""",
        entries=entries,
        bars=_numbered(bars),
    )


def one_at_a_time(trades: DataFrame) -> DataFrame:
    """Of trades that may overlap, those a symbol really takes: the next entry is at or after the last exit.

    A scan in order of entry; a symbol's trades are as many as its bars at most.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_bar", kind="stable")
        free, keep = -1, []
        for entry, leave in zip(pdf["entry_bar"], pdf["exit_bar"]):
            keep.append(entry >= free)
            if keep[-1]:
                free = leave
        return pdf[keep]

    return trades.groupBy("symbol").applyInPandas(run, trades.schema)


def pooled(signals: DataFrame, bars: DataFrame, hold: int = 10, slots: int = 1, cool_down_hours: float = 0.0) -> DataFrame:
    """One book for all symbols: signals of a bar are ranked by ``rank`` and entered at the next bar's open while
    slots are free; exits as in :func:`first_hits`, from the entry bar on; no entry in the bar after which a symbol left,
    nor within ``cool_down_hours`` of its exit.

    ``signals``: ``strategy, symbol, ts, rank, take_profit, stop_loss``. Bars are aligned by time. Trades are worked out
    for all signals at once; the scan over a strategy sees only those narrow rows.
    """
    rows = _numbered(bars)
    book = _sql(
        f"""with e as (select s.*, b.i as signal_bar from {{signals}} s join {{bars}} b on b.symbol = s.symbol and b.ts = s.ts where b.i < b.n - 1),
            p as (select *, explode(sequence(signal_bar + 1, signal_bar + {hold})) as pos from e),
            h as (select e.strategy, e.symbol, e.ts, e.rank, e.take_profit, e.stop_loss, e.signal_bar, b.i, b.ts as at, b.open, b.close, b.low <= e.stop_loss as stopped, b.high >= e.take_profit as reached
              from p e join {{bars}} b on b.symbol = e.symbol and b.i = e.pos),
            x as (select strategy, symbol, ts, rank, take_profit, stop_loss, min_by(struct(at, open), i) as entry, min_by(struct(i, at, stopped, reached, close), if(stopped or reached, i, null)) as hit, max_by(struct(i, at, close), i) as final, count(*) as seen
              from h group by strategy, symbol, ts, rank, take_profit, stop_loss)
            select strategy, symbol, ts as signal_ts, rank, entry.at as entry_ts, entry.open as entry_price, take_profit, stop_loss, coalesce(hit.at, final.at) as exit_ts,
              case when hit.stopped then stop_loss when hit.reached then take_profit else final.close end as exit_price,
              case when hit.stopped then 'SL' when hit.reached then 'TP' when seen < {hold} then 'OPEN' else 'TIMEOUT' end as exit_reason from x""",
        signals=signals,
        bars=rows,
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["signal_ts", "rank", "symbol"], ascending=[True, False, True], kind="stable")
        held: dict[str, tuple] = {}
        left: dict[str, object] = {}
        pause = pd.Timedelta(hours=cool_down_hours)
        keep = []
        for row in pdf.itertuples():
            now = row.signal_ts
            for s in [s for s, leave in held.items() if leave <= now]:
                left[s] = held.pop(s)
            gone = left.get(row.symbol)
            take = row.symbol not in held and (gone is None or gone != now and now - gone >= pause) and len(held) < slots
            keep.append(take)
            if take:
                held[row.symbol] = row.exit_ts
        return pdf[keep]

    return book.groupBy("strategy").applyInPandas(run, book.schema)


def trade_statistics(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trades, exits by reason, both win rates (of all, and of targets and stops), means and the sum of gains,
    for every group of ``by`` and for their totals (rollup; null stands for all)."""
    reason = lambda r: F.count_if(F.col("exit_reason") == r)
    tp, sl, n = reason("TP"), reason("SL"), F.count("*")
    return trades.rollup(*by).agg(
        n.alias("trades"), tp.alias("targets"), sl.alias("stops"), reason("TIMEOUT").alias("timeouts"), F.round(tp / n, 6).alias("win_rate_all"),
        F.round(F.when(tp + sl > 0, tp / (tp + sl)), 6).alias("win_rate_decided"), F.round(F.avg("pnl_pct"), 8).alias("mean_pct"), F.round(F.avg("hold_days"), 6).alias("mean_hold"),
        F.round(F.sum(F.col("pnl_usd").cast("decimal(28,6)")).cast("double"), 4).alias("gain"),
    )


def monthly(trades: DataFrame, day: str) -> DataFrame:
    """Exits by reason for each month of ``day``."""
    month = F.date_format(day, "yyyy-MM").alias("month")
    return trades.groupBy(month).pivot("exit_reason", ["TP", "SL", "TIMEOUT"]).agg(F.count("trade_id")).fillna(0)


def drawdown(trades: DataFrame, key: str, order: Sequence[str], start: float = 1000.0) -> DataFrame:
    """Final equity and the largest fall below the highest equity so far, a key."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gains = trades.withColumn("__e", start + F.sum(F.col("pnl_usd").cast("decimal(28,6)")).over(upto).cast("double"))
    peaks = gains.withColumn("__p", F.greatest(F.lit(start), F.max("__e").over(upto)))
    return peaks.groupBy(key).agg(F.round(F.max_by("__e", F.struct(*order)), 4).alias("equity"), F.round(F.max((F.col("__p") - F.col("__e")) / F.col("__p") * 100), 4).alias("drawdown_pct"))


def fee_grid(trades: DataFrame, key: str, fees: Sequence[float] = (0.0, 0.0005, 0.001, 0.002, 0.003), size: float = 100.0) -> DataFrame:
    """Gain at fixed size and growth when compounding, a key and fee (charged at entry and exit).

    The grid is a short list of constants, expanded row by row.
    """
    rows = trades.withColumn("fee", F.explode(F.array(*map(F.lit, fees))))
    net = F.col("pnl_pct") / 100 - 2 * F.col("fee")
    return rows.groupBy(key, "fee").agg(
        F.round(F.sum(F.col("pnl_usd").cast("decimal(28,6)")).cast("double") - F.count("*") * size * F.col("fee") * 2, 4).alias("fixed"),
        F.round(F.sum(F.ln(F.greatest(1 + net, F.lit(1e-12)))), 4).alias("log_growth"),
    )
