import datetime as dt
import random

from tidemark.operators.trailing import trailing_periods

SCHEMA = "feed_id bigint, ts timestamp, volume double, close double, loaded_at timestamp, bars int"


def day(k, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k, hours=hour)


def test_against_brute_force(spark):
    rng = random.Random(1)
    data = []
    for feed in (1, 2):
        for k in sorted(rng.sample(range(90), 40)):
            for hour in (0, 12)[: rng.choice((1, 2))]:
                data.append((feed, day(k, hour), rng.choice((None, 0.0, 1.25, 1e9)), round(rng.uniform(1e-5, 5e4), 6), day(k, 23), 1))
    got = {(r.feed_id, r.day): r for r in trailing_periods(spark.createDataFrame(data + data[:5], SCHEMA)).collect()}
    for feed in (1, 2):
        own = [x for x in data if x[0] == feed]
        first, last = (f(x[1] for x in own).date() for f in (min, max))
        for k in range((last - first).days + 1):
            d = first + dt.timedelta(days=k)
            r = got.pop((feed, str(d)))
            for n in (7, 30):
                window = [x for x in own if d - dt.timedelta(days=n) < x[1].date() <= d]
                assert r[f"bars_{n}"] == len(window)
                assert abs(r[f"volume_total_{n}"] - sum(x[2] or 0 for x in window)) < 1e-6
                if window:
                    assert abs(r[f"close_avg_{n}"] - sum(x[3] for x in window) / len(window)) < 1e-6
                else:
                    assert r[f"close_avg_{n}"] is None
    assert not got


def test_edges(spark):
    nan = float("nan")
    data = [(None, day(0), 1.0, 1.0, None, 1), (1, None, 1.0, 1.0, None, 1), (2, day(0), nan, float("inf"), None, 1), (3, day(0), 1.0, 5.0, day(1), 1), (3, day(0), 9.0, 7.0, day(2), 1), (4, day(3), 1e300, None, None, 1)]
    got = {r.feed_id: r for r in trailing_periods(spark.createDataFrame(data, SCHEMA)).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2].volume_total_7 == 0 and got[2].close_avg_7 is None and got[4].volume_total_30 == 1e300
    assert (got[3].volume_total_7, got[3].close_avg_7, got[3].bars) == (9.0, 7.0, 1)
    assert trailing_periods(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_large_and_very_small_values(spark):
    data = [(1, day(0), 2e16, 1e-13, None, 1), (1, day(1), 1.5, 3e-13, None, 1), (1, day(9), 3e22, 1e25, None, 1), (1, day(20), 0.25, 2.0, None, 1)]
    got = {(r.feed_id, r.day): r for r in trailing_periods(spark.createDataFrame(data, SCHEMA)).collect()}
    r = got[1, "2024-01-02"]
    assert r.volume_total_7 == 2e16 + 1.5 and abs(r.close_avg_7 - 2e-13) < 1e-25
    assert got[1, "2024-01-10"].volume_total_7 == 3e22 and got[1, "2024-01-10"].close_avg_7 == 1e25
    assert got[1, "2024-01-21"].volume_total_7 == 0.25 and got[1, "2024-01-21"].close_avg_7 == 2.0
