"""Candle series: building, resampling, incremental maintenance and checks of freshness.

A candle table has ``symbol, ts, open, high, low, close, volume``; every operator keys by symbol, so that all
series of a table are handled by one plan. ``as_of`` takes the place of the wall clock everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

OHLCV = ("open", "high", "low", "close", "volume")


def candles(df: DataFrame, symbol: Column, bucket: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """Candles of a table of prices: first and last by ``order``, highest, lowest, and the sum of ``volume``."""
    rows = df.select(symbol.alias("symbol"), bucket.alias("ts"), price.alias("p"), order.alias("o"), volume.alias("v"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume")
    )


def event_candles(events: DataFrame, unit: str = "hour") -> DataFrame:
    return candles(events, F.col("event_type"), F.date_trunc(unit, "ts"), F.col("value"), F.col("ts"), F.lit(1))


def shipment_candles(lineitem: DataFrame) -> DataFrame:
    """Daily candles of unit prices by return flag; ties within a day are ordered by all values of the row."""
    price = F.try_divide("l_extendedprice", "l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    return candles(lineitem, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), price, order, F.col("l_quantity"))


def resample(bars: DataFrame, unit: str, as_of: str | None = None) -> DataFrame:
    """Bars of calendar ``unit`` (day, week from Monday, month); with ``as_of`` only those that had ended by then.

    Rows with a null in any value are left out. The bar's label is its first day.
    """
    whole = bars.dropna(subset=list(OHLCV))
    out = whole.groupBy("symbol", F.date_trunc(unit, "ts").alias("ts_")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    out = out.withColumnRenamed("ts_", "ts")
    if as_of is None:
        return out
    return out.where(F.col("ts") + F.expr(f"interval 1 {unit}") <= F.lit(as_of).cast(out.schema["ts"].dataType))


def closed_bars(bars: DataFrame, as_of: str) -> DataFrame:
    """Bars of days before ``as_of``: the day in progress is left out."""
    return bars.where(F.to_date("ts") < F.lit(as_of).cast("date"))


def upsert_keep_last(stored: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Union in which a fresh row takes the place of the stored one. One of several equal-aged rows is kept."""
    both = stored.withColumn("__td_age", F.lit(0)).unionByName(fresh.withColumn("__td_age", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col("__td_age").desc(), *(F.col(c).desc_nulls_last() for c in stored.columns if c not in keys))
    return both.withColumn("__td_r", F.row_number().over(newest)).where("__td_r = 1").drop("__td_r", "__td_age")


def freshness(bars: DataFrame, symbols: DataFrame, as_of: str, most_missing: int = 30, unknown: int = 999) -> DataFrame:
    """For each symbol: last day, days missing, and whether to skip, append or load in full."""
    last = bars.groupBy("symbol").agg(F.max(F.to_date("ts")).alias("last_day"))
    missing = F.coalesce(F.datediff(F.lit(as_of).cast("date"), "last_day"), F.lit(unknown))
    action = F.when(missing <= 1, "skip").when(missing <= most_missing, "append").otherwise("full")
    return symbols.select("symbol").distinct().join(last, "symbol", "left").select("symbol", "last_day", missing.cast("bigint").alias("missing"), action.alias("action"))


def first_good_source(bars: DataFrame, priority: Sequence[str], least: int = 30) -> DataFrame:
    """For each symbol the bars of the first source of ``priority`` that has at least ``least`` of them."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    counts = bars.groupBy("symbol", "source").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (rank > 0))
    chosen = counts.groupBy("symbol").agg(F.min_by("source", rank).alias("source"))
    return bars.join(chosen, ["symbol", "source"], "left_semi")


def pool_klines(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Candles of payloads ``{"data": {"attributes": {"ohlcv_list": [[seconds, ...], ...]}}}``, several pages a symbol.

    Newest rows may come first; of several rows with one symbol and time the first of the first page (``page``) is kept.
    """
    inner = F.get_json_object(body, "$.data.attributes.ohlcv_list")
    return klines(payloads.withColumn(body, inner), body, "seconds")


def snapshot_candles(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Candles of payloads that hold an array of objects ``t`` (milliseconds), ``o, h, l, c, v`` (text or numbers); of
    several with one time the first is kept, unreadable ones go."""
    rows = payloads.select("symbol", F.posexplode(F.from_json(body, "array<struct<t:bigint,o:string,h:string,l:string,c:string,v:string>>")).alias("at", "k"))
    values = (F.col(f"k.{c}").try_cast("double").alias(name) for c, name in zip("ohlcv", OHLCV))
    out = rows.select("symbol", "at", F.timestamp_millis(F.col("k.t")).alias("ts"), *values).where("ts is not null and close is not null")
    first = Window.partitionBy("symbol", "ts").orderBy("at", *OHLCV)
    return out.withColumn("__td_r", F.row_number().over(first)).where("__td_r = 1").drop("__td_r", "at")


def overlap_scan(stored: DataFrame, source: DataFrame, days: int = 2) -> DataFrame:
    """Rows of ``source`` from ``days`` before each symbol's last stored day on; all rows of symbols that are not stored."""
    last = stored.groupBy("symbol").agg(F.date_sub(F.to_date(F.max("ts")), days).alias("__td_from"))
    rows = source.join(last, "symbol", "left")
    return rows.where(F.col("__td_from").isNull() | (F.to_date("ts") >= F.col("__td_from"))).select(*source.columns)


def klines(payloads: DataFrame, body: str = "body", unit: str = "millis", keep: str = "first") -> DataFrame:
    """Candles of payloads that hold an array of arrays [epoch, open, high, low, close, volume, ...].

    Numbers may be strings; of several rows with the same symbol and time the first is kept (``keep`` = 'last': the last;
    payloads with a column ``page`` are taken in its order); unreadable rows go.
    """
    page = F.col("page") if "page" in payloads.columns else F.lit(0)
    rows = payloads.select("symbol", page.alias("page"), F.posexplode(F.from_json(body, "array<array<string>>")).alias("at", "k")).withColumn("at", F.struct("page", "at")).drop("page")
    when = F.get("k", F.lit(0)).try_cast("bigint")
    ts = F.timestamp_millis(when) if unit == "millis" else F.timestamp_seconds(when)
    out = rows.select("symbol", "at", ts.alias("ts"), *(F.get("k", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(OHLCV))).where("ts is not null and close is not null")
    order = F.col("at").asc() if keep == "first" else F.col("at").desc()
    first = Window.partitionBy("symbol", "ts").orderBy(order, *OHLCV)
    return out.withColumn("__td_r", F.row_number().over(first)).where("__td_r = 1").drop("__td_r", "at")


def indexed(bars: DataFrame) -> DataFrame:
    """Adds the bar's position ``i`` from 0 and the number ``n`` of bars of its symbol."""
    by = Window.partitionBy("symbol")
    return bars.withColumn("i", (F.row_number().over(by.orderBy("ts")) - 1).cast("bigint")).withColumn("n", F.count("*").over(by))
