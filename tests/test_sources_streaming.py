import datetime as dt

from tests.conftest import rows
from tidemark.operators.scoring import manual_levels
from tidemark.sources.candle_files import read_candle_csv, read_level_lines, write_candles, write_documents
from tidemark.streaming.candles import candle_stream, hysteresis_stream, once, store_once

T0 = dt.datetime(2024, 1, 1)


def test_files(spark, tmp_path):
    (tmp_path / "aaa_daily.csv").write_text("Timestamp, Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n2024-01-02,1,2,x,1.5,\n2024-01-03,1,2,1,1.5,\n")
    bars = read_candle_csv(spark, str(tmp_path))
    assert rows(bars, "symbol", "close", "volume") == [("AAA", 1.5, 1.0), ("AAA", 1.5, 10.0)]
    write_candles(bars, str(tmp_path / "out"))
    write_candles(bars, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    write_documents(bars, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    (tmp_path / "levels.txt").write_text("# list\nBTC: 65700 60000 | 75970 x 79300\nSOL: 64.5 | 95\n")
    got = rows(manual_levels(read_level_lines(spark, str(tmp_path / "levels.txt"))))
    assert got == [("BTC", "resistance", 75970.0), ("BTC", "resistance", 79300.0), ("BTC", "support", 60000.0), ("BTC", "support", 65700.0), ("SOL", "resistance", 95.0), ("SOL", "support", 64.5)]


def drive(spark, tmp_path, batches, schema, build, name):
    """Feeds one batch after the other through a query and returns what it wrote."""
    source = tmp_path / name
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}_c")).start()
    for k, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(source / f"b{k}"))
        query.processAllAvailable()
    query.stop()
    return rows(spark.table(name))


def test_candles(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("a", at(1), 5.0, 1.0), ("a", at(50), 7.0, 1.0)], [("a", at(30), 2.0, 1.0)], [("a", at(200), 1.0, 1.0)], [("a", at(210), 1.0, 1.0)], [("a", at(5), 99.0, 1.0)], [("a", at(400), 1.0, 1.0)]]
    got = drive(spark, tmp_path, batches, "symbol string, ts timestamp, price double, volume double", lambda s: candle_stream(s), "candles")
    assert ("a", T0, 5.0, 7.0, 2.0, 7.0, 3.0) in got and all(r[3] != 99.0 for r in got)


def test_once_and_state(spark, tmp_path):
    schema = "source string, message_id string, received_at timestamp, n int"
    got = drive(spark, tmp_path, [[("s", "007", T0, 1)], [("s", "7", T0, 2), ("t", "7", T0, 3)]], schema, once, "once")
    assert sorted((r[0], r[3]) for r in got) == [("s", 1), ("t", 3)]
    values = [[("a", T0, 65.0)], [("a", T0 + dt.timedelta(1), 55.0)], [("a", T0 + dt.timedelta(2), 45.0)]]
    got = drive(spark, tmp_path, values, "symbol string, ts timestamp, value double", lambda s: hysteresis_stream(s, 60, 50), "state")
    assert sorted((r[2], r[3]) for r in got) == [(45.0, False), (55.0, True), (65.0, True)]


def test_store_once_however_late(spark, tmp_path):
    schema = "source string, message_id string, delivery_id bigint, received_at timestamp"
    source, out, state = tmp_path / "late", str(tmp_path / "kept"), str(tmp_path / "late_c")
    source.mkdir()
    for k, data in enumerate([[("s", "7", 1, T0), ("s", None, 2, T0)], [("s", "9", 3, T0 + dt.timedelta(400))], [("s", "007", 4, T0 + dt.timedelta(800)), ("s", None, 5, T0)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(source / f"b{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        store_once(stream, out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "delivery_id") == [(1,), (2,), (3,), (5,)]
