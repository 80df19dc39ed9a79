"""Overlapping, nested and gapped intervals: continuous periods and the gaps between them.

Intervals are first reduced to one row for each group and first day (its latest end), so that a group holds
at most as many rows as there are days. ``session_window`` with a row-specific duration then merges
overlapping intervals; sessions that touch without a free day are joined afterwards, and ``lead`` gives the gaps.

Defined cases: an interval without a readable start, or that ends before its start, covers nothing; an
interval without end lasts to the end its group's run gives, and covers nothing when there is none;
repeated rows change nothing; null keys form a group of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.text import day_of, trimmed


def covered_periods(df: DataFrame, keys: Sequence[str], first: str = "first_day", last: str = "last_day") -> DataFrame:
    """``keys``, ``kind`` ('period' or 'gap'), ``first_day``, ``last_day`` (both included, DATE).

    ``df`` has one DATE interval a row, both ends included.
    """
    keys = list(keys)
    spans = (
        df.where(F.col(last) >= F.col(first))
        .groupBy(*keys, F.col(first).alias("__td_first"))
        .agg(F.max(last).alias("__td_last"))
    )
    days = F.datediff("__td_last", "__td_first") + 1
    length = F.make_interval(days=days)
    sessions = (
        spans.groupBy(*keys, F.session_window(F.col("__td_first").cast("timestamp_ntz"), length).alias("__td_s"))
        .agg(F.count("*").alias("__td_n"))
        .select(*keys, F.to_date("__td_s.start").alias("__td_a"), F.to_date("__td_s.end").alias("__td_b"))
    )
    in_order = Window.partitionBy(*keys).orderBy("__td_a")
    apart = F.coalesce((F.col("__td_a") > F.lag("__td_b").over(in_order)).cast("int"), F.lit(1))
    merged = (
        sessions.withColumn("__td_new", apart)
        .withColumn("__td_island", F.sum("__td_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__td_island")
        .agg(F.min("__td_a").alias("__td_a"), F.max("__td_b").alias("__td_b"))
    )
    following = F.lead("__td_a").over(in_order)
    both = merged.select(*keys, "__td_a", "__td_b", following.alias("__td_next")).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("period").alias("kind"), F.col("__td_a").alias("first_day"), F.date_sub("__td_b", 1).alias("last_day")),
                F.struct(F.lit("gap").alias("kind"), F.col("__td_b").alias("first_day"), F.date_sub("__td_next", 1).alias("last_day")),
            )
        ).alias("__td_x"),
    )
    return both.select(*keys, "__td_x.kind", "__td_x.first_day", "__td_x.last_day").where(F.col("last_day").isNotNull())


def trade_intervals(trades: DataFrame, runs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``run_id, symbol, first_day, last_day`` of the trades; symbols as in ``tokens.symbol``.

    A symbol may be written as the token's symbol, its pair or its id, in any case; one that no token has is
    kept in upper case. The trades are reduced to distinct days before they meet runs and tokens.
    """
    written = F.upper(trimmed(F.col("symbol")))
    shut = F.coalesce(trimmed(F.col("exit_date")), F.lit(""))
    reduced = (
        trades.select("run_id", written.alias("w"), day_of(F.col("entry_date")).alias("first_day"), day_of(F.col("exit_date")).alias("x"), (shut == "").alias("open"))
        .where(F.col("first_day").isNotNull())
        .groupBy("run_id", "w", "first_day")
        .agg(F.max("x").alias("x"), F.max("open").alias("open"))
    )
    names = tokens.select(F.col("symbol").alias("named"), F.explode(F.array("symbol", "pair", "id")).alias("w"))
    names = names.select("named", F.upper(trimmed(F.col("w"))).alias("w")).where(F.col("w").isNotNull()).groupBy("w").agg(F.min("named").alias("named"))
    ends = runs.groupBy("run_id").agg(F.max(day_of(F.col("end_date"))).alias("run_end"))
    return (
        reduced.join(names, "w", "left")
        .join(ends, "run_id", "left")
        .select("run_id", F.coalesce("named", "w").alias("symbol"), "first_day", F.greatest("x", F.when(F.col("open"), F.col("run_end"))).alias("last_day"))
    )
