"""Prices as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def plain_price(p: Column) -> Column:
    """1,234.50 from 1000 up, four places from 1 up, six below; a dash for null."""
    return F.when(p.isNull(), F.lit("—")).when(p >= 1000, F.format_number(p, 2)).when(p >= 1, F.format_string("%.4f", p)).otherwise(F.format_string("%.6f", p))


def dollar_price(p: Column) -> Column:
    """With a dollar sign and as many places as the size of the price wants; null for null."""
    out = None
    for least, digits in ((1000, 0), (10, 1), (1, 2), (0.01, 4), (0.0001, 6)):
        value = F.concat(F.lit("$"), F.format_number(p, digits))
        out = F.when(p >= least, value) if out is None else out.when(p >= least, value)
    return out.otherwise(F.concat(F.lit("$"), F.format_number(p, 8)))
