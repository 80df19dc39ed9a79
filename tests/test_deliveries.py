import random

from tests.conftest import rows
from tidemark.operators.deliveries import first_deliveries, new_messages, repeated_deliveries

SCHEMA = "source string, message_id string, delivery_id bigint, rank int, KEY int, alone int, close double"
UUID = "10e5aa19-1208-d7e5-df18-6567531d673c"


def frame(spark, data):
    return spark.createDataFrame([(s, m, d, 5, 5, 5, float(d or 0)) for s, m, d in data], SCHEMA)


def test_identifiers_typed_in_different_ways(spark):
    same = [("a", UUID, 1), ("a", UUID.upper(), 2), ("a", UUID.replace("-", "") + "\t", 3), ("b", UUID, 4), ("a", "007", 5), ("a", " 7 ", 6), ("a", "KL.1.R1", 7), ("a", "kl.1", 8)]
    df = frame(spark, same)
    assert rows(repeated_deliveries(df)) == [(2,), (3,), (6,)]
    assert rows(first_deliveries(df), "delivery_id") == [(1,), (4,), (5,), (7,), (8,)]
    assert first_deliveries(df).columns == df.columns


def test_without_identifier_and_repeated_rows(spark):
    df = frame(spark, [("a", None, 1), ("a", None, 2), ("a", "", 3), ("a", " ", 4), (None, "x", 5), (None, "x", 6), ("a", "x", 7), ("a", "x", 7), ("a", "y", None), ("a", "y", 8)])
    assert rows(repeated_deliveries(df)) == [(6,)]
    assert rows(first_deliveries(df), "delivery_id") == [(1,), (2,), (3,), (4,), (5,), (7,), (8,)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(repeated_deliveries(df)) == [] and rows(first_deliveries(df)) == [] and rows(new_messages(df, df)) == []


def test_new_messages(spark):
    stored, batch = frame(spark, [("a", "1", 1), ("b", "2", 2)]), frame(spark, [("a", "001", 3), ("a", "2", 4), ("a", "2", 5), (None, "1", 6), ("a", None, 7)])
    assert rows(new_messages(batch, stored), "delivery_id") == [(4,), (6,), (7,)]


def test_against_brute_force_with_a_hot_message(spark):
    rng = random.Random(3)
    data = [("s", "hot" if rng.random() < 0.4 else str(rng.randrange(40)), i) for i in range(600)]
    rng.shuffle(data)
    seen, expected = set(), []
    for s, m, d in sorted(data, key=lambda x: x[2]):
        key = m.lstrip("0") or "0"
        expected += [(d,)] if key in seen else []
        seen.add(key)
    assert rows(repeated_deliveries(frame(spark, data).repartition(7))) == sorted(expected, key=str)


def test_each_row_without_identifier_is_kept(spark):
    df = frame(spark, [("a", None, 1), ("a", "", 1), ("a", None, 1), ("a", "x", 1)])
    assert len(rows(first_deliveries(df))) == 4 and rows(repeated_deliveries(df)) == []
