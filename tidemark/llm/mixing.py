"""Mixing sources to target weights, sizes in tokens.

Each source of a mix gets a target number of tokens. The expected copies of a document are proportional to its
weight, but no more than the cap, by the factor at which they add up to the target; it is found on sums over weights
of much the same size. The whole copies are certain, and the rest is filled by Pareto order sampling: documents are
ranked by random odds over inclusion odds, and the lowest ranks are taken until the remaining tokens are reached.

The order is never sorted in one place: ranks are cut into ``buckets`` ranges, tokens are summed a range, and
only the one range in which a source reaches its target is ordered document by document. All of it is one plan: the
sizes of the documents lie in one exchange, which every part reads.

Defined cases: weights count as shares of their mix; a null or negative weight is 0; of repeated targets of one
source the weights add up and the smallest cap holds; source names match in any writing; documents without
source or tokens are in no mix; repeated rows of a document count once; a source without documents reaches 0 and
does not hold the others back; random numbers follow from document, mix and seed, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import source_key
from tidemark.llm.bpe import VOCABULARY, count_tokens
from tidemark.operators.sizing import small

FINE = 256  # sums of weights within a 256th of an octave


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """``doc, source, tokens`` of every document with a source and at least one token."""
    named = docs.select(F.col(key).alias("doc"), source_key(F.col(source)).alias("source"), F.col(text).alias("text")).where("source is not null and doc is not null and text <> ''")
    return count_tokens(named, ["doc", "source"], "text", path).groupBy("doc", "source").agg(F.max("tokens").alias("tokens")).where("tokens > 0")


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """A row for each mix and source with its target; as many rows as ``targets`` at most."""
    weight = F.greatest(F.coalesce(F.col("target_weight"), F.lit(0.0)), F.lit(0.0))
    wanted = targets.select("mix_name", source_key(F.col("source")).alias("source"), weight.alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
    wanted = wanted.where("source is not null").groupBy("mix_name", "source").agg(F.sum("w").alias("w"), F.min("cap").alias("cap"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("docs")).join(small(wanted.select("source").distinct(), targets), "source", "left_semi")
    mix = Window.partitionBy("mix_name")
    share = F.when(F.sum("w").over(mix) > 0, F.col("w") / F.sum("w").over(mix)).otherwise(F.lit(0.0))
    rows = wanted.join(small(have, targets), "source", "left").withColumn("share", share).fillna(0, ["size", "docs"])
    most = F.when((F.col("share") > 0) & (F.col("size") > 0), F.col("size") * F.col("cap") / F.col("share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(most).over(mix), F.lit(0.0))
    return rows.withColumn("target", F.least(F.col("share") * total, (F.col("size") * F.col("cap")).cast("double")))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return F.ln(p / (1 - p))


def _factors(weighed: DataFrame, plan: DataFrame, targets: DataFrame) -> DataFrame:
    """``plan`` with the ``factor`` at which the expected copies, factor times weight but at most the cap, add up to the target."""
    bins = weighed.groupBy("source", F.floor(F.log2("weight") * FINE).alias("bin")).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("wt"))
    rows = bins.join(small(plan, targets), "source")
    heavy = Window.partitionBy("mix_name", "source").orderBy(F.col("bin").desc())
    above = F.coalesce(F.sum("t").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("wt").over(heavy.rowsBetween(0, Window.unboundedFollowing))
    # all heavier weights at the cap: right where this bin itself stays below it
    tried = rows.withColumn("factor", (F.col("target") - F.col("cap") * above) / rest)
    fits = F.col("factor") * F.col("wt") <= F.col("cap") * F.col("t") * (1 + 1e-9)
    found = tried.groupBy("mix_name", "source").agg(
        F.max("cap").alias("cap"), F.max("target").alias("target"), F.max_by("factor", F.when(fits, F.col("bin"))).alias("factor"), F.min_by("factor", "bin").alias("lowest")
    )
    return found.select("mix_name", "source", "cap", "target", F.greatest(F.coalesce("factor", "lowest"), F.lit(0.0)).alias("factor"))


def mix_documents(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, buckets: int = 16384, weight: Column | None = None) -> DataFrame:
    """``mix_name, doc, source, tokens, copies`` of every document a mix uses.

    ``total_tokens``: size of each mix; by default the largest at which every source that has documents can reach
    its share. ``weight``: a column expression over ``doc, source, tokens`` to which the expected copies are
    proportional (1 for all by default); a document never gets more than the source's cap. A null, negative or zero weight
    counts as 1e-9.
    """
    plan = _plan(sizes, targets, total_tokens).where("target > 0").select("mix_name", "source", "cap", "target")
    weighed = sizes.withColumn("weight", F.greatest(F.coalesce((weight if weight is not None else F.lit(1.0)).cast("double"), F.lit(0.0)), F.lit(1e-9)))
    factor = _factors(weighed, plan, targets)
    # as many rows as the target table at most
    rows = weighed.join(small(factor, targets), "source")
    expected = F.least(F.col("factor") * F.col("weight"), F.col("cap").cast("double"))
    u = (F.pmod(F.xxhash64("doc", "mix_name", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    part = F.col("expected") - F.col("whole")
    rows = rows.withColumn("rank", _logit(u) - _logit(part))
    # from 0 to 1, with the end of the sample near the middle, in equal ranges
    spread = 1 / (1 + F.exp(-F.greatest(F.least(F.col("rank"), F.lit(700.0)), F.lit(-700.0))))
    rows = rows.withColumn("range", F.least(F.floor(spread * buckets), F.lit(buckets - 1))).withColumn("more", F.when(F.col("whole") < F.col("cap"), F.col("tokens")).otherwise(F.lit(0)))
    sums = rows.groupBy("mix_name", "source", "range").agg(F.sum("more").alias("more"), F.sum(F.col("whole") * F.col("tokens")).alias("certain"), F.max("target").alias("target"))
    by = Window.partitionBy("mix_name", "source")
    ordered = by.orderBy("range")
    cut = (
        sums.withColumn("rest", F.col("target") - F.sum("certain").over(by))
        .withColumn("before", F.sum("more").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("before", F.coalesce("before", F.lit(0)))
        .where("before < rest")
        .groupBy("mix_name", "source")
        .agg(F.max("range").alias("last"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    )
    placed = rows.join(small(cut, targets), ["mix_name", "source"], "left")
    columns = ["mix_name", "doc", "source", "tokens"]
    clear = placed.where("last is null or range <> last").select(
        *columns, (F.col("whole") + F.when((F.col("range") < F.col("last")) & (F.col("whole") < F.col("cap")), 1).otherwise(0)).alias("copies")
    )
    inside = Window.partitionBy("mix_name", "source").orderBy("rank", "doc").rowsBetween(Window.unboundedPreceding, 0)
    # the document that crosses the target is taken when that is nearer to it
    reach = F.col("before") + F.sum("more").over(inside) - F.col("more") / 2
    edge = placed.where("range = last").select(*columns, "whole", "cap", (reach <= F.col("rest")).alias("in")).select(
        *columns, (F.col("whole") + F.when(F.col("in") & (F.col("whole") < F.col("cap")), 1).otherwise(0)).alias("copies")
    )
    return clear.unionByName(edge).where("copies > 0").withColumn("copies", F.col("copies").cast("int"))


def reached_shares(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, buckets: int = 16384, weight: Column | None = None) -> DataFrame:
    """For each mix and source: target share, tokens and share reached, documents used and most copies of one."""
    plan = _plan(sizes, targets, total_tokens)
    used = mix_documents(sizes, targets, total_tokens, seed, buckets, weight).groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    rows = plan.join(used, ["mix_name", "source"], "left").fillna(0, ["reached_tokens", "documents", "most_copies"])
    total = F.sum("reached_tokens").over(Window.partitionBy("mix_name"))
    return rows.select(
        "mix_name",
        "source",
        F.col("share").alias("target_share"),
        F.round("target").cast("bigint").alias("target_tokens"),
        F.col("reached_tokens").cast("bigint").alias("reached_tokens"),
        F.when(total > 0, F.col("reached_tokens") / total).otherwise(F.lit(0.0)).alias("reached_share"),
        F.col("documents").cast("bigint").alias("documents"),
        F.col("most_copies").cast("int").alias("most_copies"),
    )
