"""Totals and averages over trailing calendar periods, days without activity included.

Bars are reduced to one row an entity and day; decimal prefix sums over these rows are carried forward
across the days without bars (each row fills the days up to the next one), and a trailing figure is the
difference of two prefix values. Decimals make the differences exact. What a decimal of twelve places cannot hold
(a value of 1e20 or more, or what lies below the twelfth place) is kept beside it as a double and summed over the
period's own days, where a difference of prefixes would lose it. After the reduction an entity has at
most one row a day, so the windows per entity are bounded by the calendar even for a hot entity.

Defined cases: rows without entity or time are left out (they belong to no day); repeated rows count once,
and of rows with the same entity and time the last loaded counts; a null, NaN or infinite
value is no reading: it adds nothing and is not averaged; a total over no reading is 0, an average null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _reading(col: Column) -> Column:
    return F.when(col.isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf")), col)


def _exact(col: Column) -> Column:
    """The part of a reading that a decimal holds."""
    return F.when(F.abs(col) < 1e20, col).cast("decimal(33,12)")


def _rest(col: Column) -> Column:
    """The part of a reading that :func:`_exact` leaves; 0 for nearly all."""
    return col - F.coalesce(_exact(col).cast("double"), F.lit(0.0))


def trailing_periods(
    df: DataFrame,
    entity: str = "feed_id",
    ts: str = "ts",
    total: str = "volume",
    average: str = "close",
    loaded: str = "loaded_at",
    periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """One row for each entity and day from its first to its last: ``bars`` of the day and, for each period of
    n days, ``bars_n``, ``<total>_total_n`` and ``<average>_avg_n``."""
    picked = df.select(
        F.col(entity).alias("e"), F.col(ts).alias("t"), F.col(total).cast("double").alias("v"), F.col(average).cast("double").alias("c"), F.col(loaded).alias("l")
    ).where(F.col("e").isNotNull() & F.col("t").isNotNull())
    bars = picked.groupBy("e", "t").agg(F.max_by(F.struct("v", "c"), F.struct("l", "v", "c")).alias("x"))
    daily = (
        bars.select("e", F.to_date("t").alias("day"), _reading(F.col("x.v")).alias("v"), _reading(F.col("x.c")).alias("c"))
        .groupBy("e", "day")
        .agg(
            F.sum(_exact(F.col("v"))).alias("v"), F.sum(_exact(F.col("c"))).alias("c"), F.sum(_rest(F.col("v"))).alias("rv"), F.sum(_rest(F.col("c"))).alias("rc"),
            F.count("c").alias("nc"), F.count("*").alias("n"),
        )
    )
    by_day = Window.partitionBy("e").orderBy("day")
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    prefix = daily.select(
        "e",
        "day",
        F.col("n").alias("bars"),
        "rv",
        "rc",
        F.lead("day").over(by_day).alias("next_day"),
        *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"p{c}") for c in ("v", "c", "nc", "n")),
    )
    # each row stands for its own day and the empty days after it: the prefix carried forward
    until = F.coalesce(F.date_sub("next_day", 1), F.col("day"))
    dense = prefix.select("e", "bars", "pv", "pc", "pnc", "pn", "rv", "rc", F.col("day").alias("first_day"), F.explode(F.sequence("day", until)).alias("day"))
    own = lambda c: F.when((F.col("day") == F.col("first_day")) & (F.col(c) != 0), F.col(c)).alias(c)
    dense = dense.select("e", "bars", "pv", "pc", "pnc", "pn", own("rv"), own("rc"), "first_day", "day")
    out = [
        F.col("e").alias(entity),
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.when(F.col("day") == F.col("first_day"), F.col("bars")).otherwise(F.lit(0)).cast("bigint").alias("bars"),
    ]
    for n in periods:
        rest = {c: F.coalesce(F.sum(c).over(by_day.rowsBetween(1 - n, 0)), F.lit(0.0)) for c in ("rv", "rc")}
        back = {c: F.col(c) - F.coalesce(F.lag(c, n).over(by_day), F.lit(0)) for c in ("pv", "pc", "pnc", "pn")}
        out += [
            back["pn"].cast("bigint").alias(f"bars_{n}"),
            (back["pv"].cast("double") + rest["rv"]).alias(f"{total}_total_{n}"),
            F.when(back["pnc"] > 0, (back["pc"].cast("double") + rest["rc"]) / back["pnc"].cast("double")).alias(f"{average}_avg_{n}"),
        ]
    return dense.select(*out)
