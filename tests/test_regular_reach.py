import datetime as dt

import numpy as np
import pytest

from tidemark.operators.regular import regular_grid

READ, STEP = "feed_id bigint, ts timestamp, close double, value string", "feed_id bigint, step_minutes int"
T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("readings, apart, outage", [(16, 1 / 16, 40), (8, 1 / 8, 40), (60, 75.0, 0)])
def test_blocks_make_no_difference_at_any_density(spark, readings, apart, outage):
    """Blocks of 64 steps against one pass, with an outage over a block's edge, or one reading in more than a block."""
    rng = np.random.default_rng(6)
    k = (np.arange(320 / apart if apart < 1 else readings) + 0.5) * apart
    k = k[(k < 250) | (k > 250 + outage)] if outage else k
    y = 100 + np.cumsum(rng.normal(size=len(k)))
    df = spark.createDataFrame([(7, T0 + dt.timedelta(minutes=float(a) * 5), float(b), "x") for a, b in zip(k, y)], READ)
    steps = spark.createDataFrame([(7, 5)], STEP)
    small, whole = ([tuple(r) for r in regular_grid(df, steps, block_steps=b).orderBy("slot_start").collect()] for b in (64, 1 << 20))
    assert [r[:2] + r[4:] for r in small] == [r[:2] + r[4:] for r in whole]
    assert max(abs(a[2] - b[2]) / b[3] for a, b in zip(small, whole)) < 1e-6
