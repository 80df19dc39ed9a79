"""Every registered query runs on the smallest tables and, where there is SQL, agrees with DuckDB."""

import glob
import math
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str([plain(x) for x in v])


def names():
    import __spark_entry__

    # the queries of the text problems are tested beside their operators
    return [name for plan in __spark_entry__._PLANS if "llm" not in plan.__name__ for name in plan.QUERIES]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        found = [d[0] for d in r.description]
        assert sorted(found) == columns
        order = [found.index(c) for c in columns]
        expected = sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())
        assert len(got) == len(expected)
        assert sum(a != b for a, b in zip(got, expected)) == 0
