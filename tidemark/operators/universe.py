"""Which tokens to work on: discovery from a ranked list, and tiers that contain each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import trimmed
from tidemark.operators.sizing import small

TIERS = ("top_3", "selected", "all")


def _symbol(fixes: Mapping[str, str]) -> Column:
    s = F.upper(trimmed(F.col("symbol")))
    if not fixes:
        return s
    fixed = F.create_map(*(F.lit(x) for pair in fixes.items() for x in pair))
    return F.coalesce(F.try_element_at(fixed, s), s)


def token_universe(tokens: DataFrame, known: DataFrame, stable: Sequence[str] = (), fixes: Mapping[str, str] | None = None, target: int = 50) -> DataFrame:
    """``symbol, market_cap_rank, tier, known`` of the first ``target`` tokens by rank, those of ``known`` before others.

    Symbols are upper case and go through ``fixes``; one of a single letter, with an underscore, without rank, or in
    ``stable`` is left out; of tokens with one symbol the best ranked counts. The limit is the operator's purpose.
    """
    t = tokens.withColumn("symbol", _symbol(fixes or {}))
    good = t.where((F.length("symbol") > 1) & ~F.col("symbol").contains("_") & F.col("market_cap_rank").isNotNull() & ~F.col("symbol").isin(*stable))
    first = good.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy("market_cap_rank", "id"))).where("__r = 1")
    seen = known.select(F.upper(trimmed(F.col("symbol"))).alias("symbol"), F.lit(True).alias("known")).where("symbol is not null").distinct()
    rows = first.join(small(seen, known), "symbol", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.orderBy(F.col("known").desc(), "market_cap_rank", "symbol").limit(target).select("symbol", "market_cap_rank", "tier", "known")


def tier_sets(tokens: DataFrame) -> DataFrame:
    """``tier, symbol``: every symbol in its own tier and in all wider ones; an unknown tier is the widest."""
    own = F.greatest(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(0))
    first = F.when(own > 0, own).otherwise(F.lit(len(TIERS)))
    tiers = F.slice(F.array(*map(F.lit, TIERS)), first.cast("int"), F.lit(len(TIERS)))
    return tokens.select(F.upper(trimmed(F.col("symbol"))).alias("symbol"), F.explode(tiers).alias("tier")).where("symbol is not null").distinct()


def tier_inclusion(members: DataFrame, strict: bool = False) -> DataFrame:
    """``tier, members, missing_above`` of a table ``tier, symbol``: members of each tier, and those that the next wider
    tier lacks, 0 where the tiers contain each other. ``strict`` raises an error instead of reporting a lack."""
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    sets = members.groupBy("symbol").agg(F.collect_set(place).alias("places"))
    each = sets.withColumn("place", F.explode("places"))
    lacking = F.count_if((F.col("place") < len(TIERS)) & ~F.array_contains("places", F.col("place") + 1))
    out = each.groupBy(F.element_at(F.array(*map(F.lit, TIERS)), F.col("place").cast("int")).alias("tier")).agg(F.count("*").alias("members"), lacking.alias("missing_above"))
    if strict:
        out = out.withColumn("missing_above", F.when(F.col("missing_above") > 0, F.raise_error(F.lit("a tier is not contained in the next one"))).otherwise(F.col("missing_above")))
    return out
