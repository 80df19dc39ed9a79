"""Price levels named in texts, agreement of sources, and scores of found levels against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.levels import _sql, gap_clusters

# The four ways a price is written in a text.
PRICE_PATTERNS = (
    r"\$[\s]*([\d,]+(?:\.\d+)?)",
    r"([\d,]+(?:\.\d+)?)\s*(?:USD|USDT)",
    r"(?:^|\n)\s*-?\s*\$?([\d,]+(?:\.\d+)?)\s*$",
    r"(?:at|around|near|level|price)\s*\$?([\d,]+(?:\.\d+)?)",
)


def prices_in(text: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Sorted distinct positive prices written in ``text``, within bounds where given; an empty array for null."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?imd){p}"), F.lit(1)) for p in PRICE_PATTERNS))
    values = F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    keep = F.filter(values, lambda v: v.isNotNull() & (v > 0) & (v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True)))
    return F.coalesce(F.array_sort(F.array_distinct(keep)), F.expr("cast(array() as array<double>)"))


def context_levels(texts: DataFrame, key: str, text: str, last: Column | None = None) -> DataFrame:
    """``key, side, price``: prices under the last word 'support' or 'resistance' of the lines before.

    Other prices are unknown, or with ``last`` (a price that goes with ``key``) taken by their place below it or not."""
    lines = texts.select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text), r"[|\n]")).alias("line", "s"))
    low = F.lower("s")
    word = F.when(low.contains("support"), "support").when(low.contains("resistance"), "resistance")
    seen = F.last(word, ignorenulls=True).over(Window.partitionBy("k").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    sided = lines.select("k", "s", F.coalesce(seen, F.lit("unknown")).alias("side"))  # before lines without prices go
    rows = sided.select("k", "side", F.explode(prices_in(F.col("s"))).alias("price"))
    if last is not None:
        rows = rows.withColumn("side", F.when(F.col("side") != "unknown", F.col("side")).when(F.col("price") < last, "support").otherwise("resistance"))
    return rows.distinct().withColumnRenamed("k", key)


def manual_levels(lines: DataFrame, line: str = "value") -> DataFrame:
    """``symbol, side, price`` of lines such as ``SYM: 10 9.5 | 11 12``; comments and other tokens are passed over."""
    parts = lines.where(~F.col(line).startswith("#") & F.col(line).contains(":")).select(F.upper(F.trim(F.split(line, ":")[0])).alias("symbol"), F.split(F.split(line, ":")[1], r"\|").alias("p"))
    rows = parts.select("symbol", F.posexplode("p").alias("at", "t")).where(F.col("at") < 2)
    tokens = rows.select("symbol", F.when(F.col("at") == 0, "support").otherwise("resistance").alias("side"), F.explode(F.split(F.trim("t"), r"\s+")).alias("x"))
    return tokens.where(F.col("x").rlike(r"^\d+(\.\d+)?$")).select("symbol", "side", F.col("x").cast("double").alias("price"))


def consensus(levels: DataFrame, within_pct: float = 3.0) -> DataFrame:
    """Levels of one side a symbol, chained while the next lies within a share of the last: mean, members and sources."""
    keyed = levels.withColumn("k", F.concat_ws("|", "symbol", "side"))
    grouped = gap_clusters(keyed, f"(x - y) / y * 100 > {within_pct}", key="k")
    return _sql("select symbol, side, round(avg(price), 2) as price, count(*) as members, array_join(array_sort(collect_set(source)), '+') as sources from {g} group by symbol, side, cluster", g=grouped)


def match_scores(found: DataFrame, reference: DataFrame, within_pct: float = 3.0) -> DataFrame:
    """Per symbol: references matched by a found level of their side, precision, recall and F1.

    A found level counts as right when it is the first (by ``pos``) that matches some reference.
    """
    return _sql(
        f"""with m as (select r.symbol, r.side, r.price, min_by(f.price, f.pos) as hit from {{reference}} r join {{found}} f on f.symbol = r.symbol and f.side = r.side
              and abs(f.price - r.price) / greatest(r.price, 1) * 100 <= {within_pct} group by r.symbol, r.side, r.price),
            h as (select symbol, count(*) as hits, count(distinct side, hit) as right from m group by symbol), f as (select symbol, count(*) as found from {{found}} group by symbol),
            n as (select symbol, count(*) as refs from {{reference}} group by symbol)
            select n.symbol, n.refs, coalesce(f.found, 0) as found, coalesce(h.hits, 0) as hits, round(coalesce(h.hits, 0) / n.refs, 3) as recall, round(coalesce(h.right / f.found, 0), 3) as precision,
              round(coalesce(2 * (h.right / f.found) * (h.hits / n.refs) / (h.right / f.found + h.hits / n.refs), 0), 3) as f1
            from n left join f on f.symbol = n.symbol left join h on h.symbol = n.symbol""",
        found=found,
        reference=reference,
    )


def missed(found: DataFrame, reference: DataFrame, within_pct: float = 3.0) -> DataFrame:
    """References that no found level of either side lies near."""
    near = (F.col("f.symbol") == F.col("r.symbol")) & (F.abs(F.col("f.price") - F.col("r.price")) / F.greatest(F.col("r.price"), F.lit(1)) * 100 <= within_pct)
    return reference.alias("r").join(found.alias("f"), near, "left_anti")
