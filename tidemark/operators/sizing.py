"""Broadcasting only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LIMIT = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``: file sizes for a scan; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, bound: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``df`` marked for broadcast if ``bound``, a table that has at least as many rows, is at most ``limit`` bytes.

    Otherwise ``df`` as it is: the planner then joins by exchange, and decides again from the sizes met at run time.
    """
    return F.broadcast(df) if estimated_bytes(bound) <= limit else df
