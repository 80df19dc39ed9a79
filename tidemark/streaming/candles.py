"""Streaming forms: candles with late data, deliveries once, and a keyed on/off state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.text import identifier_key
from tidemark.operators.deliveries import first_deliveries, new_messages


def candle_stream(ticks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candles of ``symbol, ts, price, volume``; a candle is final when the watermark has passed its end."""
    windowed = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length).alias("w"))
    out = windowed.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def once(deliveries: DataFrame, identifier: str = "message_id", received: str = "received_at", late: str = "1 day") -> DataFrame:
    """First delivery of each message within ``late``; state older than that is given up, so that a later repeat passes:
    :func:`store_once` has no such limit. Rows without identifier pass."""
    columns = deliveries.columns
    key = F.coalesce(identifier_key(F.col(identifier)), F.uuid())
    rows = deliveries.withWatermark(received, late).withColumn("__td_key", key)
    return rows.dropDuplicatesWithinWatermark(["source", "__td_key"]).select(*columns)


def store_once(deliveries: DataFrame, path: str, checkpoint: str, identifier: str = "message_id", scope: Sequence[str] = ("source",), arrival: Sequence[str] = ("delivery_id",)) -> StreamingQuery:
    """Writes each message of a stream to ``path`` once, however late its repeats come.

    Every micro-batch is screened against the identifiers stored by the batches before it; a batch that is run again
    after a failure overwrites its own part only. Runs until the input at hand is used up.
    """

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        parts = session._jvm.org.apache.hadoop.fs.Path(path)
        there = parts.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).exists(parts)
        stored = session.read.parquet(path).where(F.col("batch") < number) if there else None
        fresh = new_messages(batch, stored, identifier, scope, arrival) if there else first_deliveries(batch, identifier, scope, arrival)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return deliveries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hysteresis_stream(values: DataFrame, on_above: float, off_below: float) -> DataFrame:
    """``symbol, ts, value, on`` of ``symbol, ts, value``: each symbol's state is kept from batch to batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else False
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            flags = []
            for v in pdf["value"]:
                on = True if v > on_above else False if v < off_below else on
                flags.append(on)
            yield pdf.assign(on=flags)
        state.update((on,))

    return values.select("symbol", "ts", "value").groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, value double, on boolean", "on boolean", "append", GroupStateTimeout.NoTimeout)
