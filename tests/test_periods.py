import datetime as dt
import random

from tests.conftest import rows
from tidemark.operators.periods import covered_periods, trade_intervals

D0 = dt.date(2024, 1, 1)


def day(k):
    return D0 + dt.timedelta(days=k)


def test_against_days_covered(spark):
    rng = random.Random(5)
    data = [(rng.randrange(3), "x", a := rng.randrange(120), a + rng.randrange(-2, 9)) for _ in range(60)]
    df = spark.createDataFrame([(g, k, day(a), day(b)) for g, k, a, b in data + data[:5]], "g int, kind2 string, first_day date, last_day date")
    expected = []
    for g in range(3):
        days = sorted({d for gg, _, a, b in data if gg == g for d in range(a, b + 1)})
        runs = []
        for d in days:
            if runs and d == runs[-1][1] + 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        expected += [(g, "period", day(a), day(b)) for a, b in runs] + [(g, "gap", day(p[1] + 1), day(q[0] - 1)) for p, q in zip(runs, runs[1:])]
    assert rows(covered_periods(df, ["g"])) == sorted(expected, key=str)


def test_trades(spark):
    trades = [
        (1, "AAAA", "2024-01-02", "2024/01/05"), (1, " aaaaZUSD ", "20240106", "7 Jan 2024"), (1, "aaaa-coin", "2024-01-10T00:00:00+00:00", None), (1, "Aaaa", "2024-01-09", "2024-01-01"),
        (2, "bbbb", "2024-01-03", " "), (2, "bbbb", None, "2024-01-03"), (3, "AAAA", "2024-01-03", ""), (None, "AAAA", "2024-02-01", "2024-02-01"), (1, "AAAA", "2024-01-02", "2024/01/05"), (2, "bbbb", "soon", "2024-01-03"),
    ]
    t = spark.createDataFrame(trades, "run_id bigint, symbol string, entry_date string, exit_date string")
    runs = spark.createDataFrame([(1, "2024-01-12"), (2, "2024-01-02"), (2, "2024-01-04")], "run_id bigint, end_date string")
    tokens = spark.createDataFrame([("aaaa-coin", "AAAA", "AAAAZUSD"), (None, None, None)], "id string, symbol string, pair string")
    got = rows(covered_periods(trade_intervals(t, runs, tokens), ["run_id", "symbol"]))
    assert sorted([(r[0], r[1], r[2], str(r[3])[5:], str(r[4])[5:]) for r in got], key=str) == sorted(
        [(1, "AAAA", "gap", "01-08", "01-09"), (1, "AAAA", "period", "01-02", "01-07"), (1, "AAAA", "period", "01-10", "01-12"), (2, "BBBB", "period", "01-03", "01-04"), (None, "AAAA", "period", "02-01", "02-01")], key=str
    )


def test_empty(spark):
    assert covered_periods(spark.createDataFrame([], "g int, first_day date, last_day date"), ["g"]).collect() == []
