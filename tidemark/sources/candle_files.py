"""Candle files and level lists on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F



def read_candle_csv(spark: SparkSession, path: str, suffix: str = "daily", default_volume: float = 1.0) -> DataFrame:
    """Candles of files ``SYMBOL_<suffix>.csv`` below ``path``: one scan, the symbol from the file's name.

    Columns are taken by the header's names in any case; rows without a readable time or price are left out, a
    missing volume gets ``default_volume``.
    """
    raw = spark.read.option("header", True).csv(f"{path}/*_{suffix}.csv")
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    if "volume" not in raw.columns:
        raw = raw.withColumn("volume", F.lit(None).cast("string"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+)_{suffix}\.csv$", 1)
    rows = raw.select(F.upper(name).alias("symbol"), F.try_to_timestamp("timestamp").alias("ts"), *(number(c) for c in ("open", "high", "low", "close")), F.coalesce(F.col("volume").try_cast("double"), F.lit(default_volume)).alias("volume"))
    return rows.dropna(subset=["ts", "open", "high", "low", "close"])


def write_candles(bars: DataFrame, path: str) -> None:
    """Parquet by symbol; files of a symbol are replaced as a whole, by Spark's commit protocol."""
    bars.repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_level_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a level list, for :func:`tidemark.operators.scoring.manual_levels`."""
    return spark.read.text(path)
