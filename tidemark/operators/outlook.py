"""Outlook of a series at its last bar: means, trend and structure labels, notes on zones, and a summary in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.levels import _numbered, _sql, anchored_clusters, gap_clusters

MEANS = (20, 50, 100, 200)
# Windows up to so many days, and the settings of the detectors for them.
PRESETS = (
    (30, "short", 3, 15, 80, 65, (3, 5, 10), 1.0, 7, 1.0, 10),
    (90, "medium", 5, 30, 120, 70, (5, 10, 20), 1.5, 20, 1.0, 20),
    (None, "long", 5, 45, 150, 70, (5, 10, 20, 50), 1.5, 60, 1.0, 40),
)
PRESET_FIELDS = ("preset", "swing_window", "swing_half_life", "bins", "node_percentile", "touch_windows", "least_touches", "touch_half_life", "body_times", "body_half_life")


def detector_preset(days: Column) -> Column:
    """Settings of the level detectors for a window of so many days, as a struct; null for null."""
    out = None
    for most, *values in PRESETS:
        struct = F.struct(*(F.array(*map(F.lit, v)).alias(n) if isinstance(v, tuple) else F.lit(v).alias(n) for n, v in zip(PRESET_FIELDS, values)))
        fits = days <= most if most is not None else days.isNotNull()
        out = F.when(fits, struct) if out is None else out.when(fits, struct)
    return out


def market_structure(bars: DataFrame, order: int = 10) -> DataFrame:
    """``symbol, bars, last, sma_*, trend, structure, bias`` at each symbol's last bar.

    The trend compares the close with the means of 50 and 200 bars, in short series with the bar a third of the series
    (rounded up) before the end; structure and bias the last two strict body extremes of ``order`` bars of either kind.
    """
    means = ", ".join(f"if(n >= {p}, avg(if(i >= n - {p}, close, null)), null) as sma_{p}" for p in MEANS)
    return _sql(
        f"""with x as (select symbol, i, top, bottom, top > max(top) over p and top > max(top) over q as peak, bottom < min(bottom) over p and bottom < min(bottom) over q as dip from {{bars}}
              window p as (partition by symbol order by i rows between {order} preceding and 1 preceding), q as (partition by symbol order by i rows between 1 following and {order} following)),
            r as (select symbol, 'h' as kind, top as price, row_number() over (partition by symbol order by i desc) as age from x where peak
              union all select symbol, 'l', bottom, row_number() over (partition by symbol order by i desc) from x where dip),
            s as (select symbol, max(if(kind = 'h' and age = 1, price, null)) as h1, max(if(kind = 'h' and age = 2, price, null)) as h2, max(if(kind = 'l' and age = 1, price, null)) as l1, max(if(kind = 'l' and age = 2, price, null)) as l2 from r where age <= 2 group by symbol),
            m as (select symbol, n as bars, max_by(close, i) as last, max(if(i = n - cast(ceil(n / 3) as bigint), close, null)) as third, {means} from {{bars}} group by symbol, n),
            j as (select m.*, h1 > h2 as hh, l1 > l2 as hl from m left join s on s.symbol = m.symbol)
            select symbol, bars, last, {', '.join(f'sma_{p}' for p in MEANS)},
              case when sma_50 is not null and sma_200 is not null then case when sma_50 > sma_200 and last > sma_50 then 'Bullish' when sma_50 < sma_200 and last < sma_50 then 'Bearish' when last > sma_50 then 'Recovering' else 'Weakening' end
                when sma_50 is not null then if(last > sma_50, 'Bullish', 'Bearish') else if(last > third, 'Bullish (ST)', 'Bearish (ST)') end as trend,
              case when hh is null or hl is null then 'Undefined' when hh and hl then 'HH + HL (Bullish)' when not hh and not hl then 'LH + LL (Bearish)' when hh then 'HH + LL (Transition)' else 'LH + HL (Compression)' end as structure,
              case when hh and hl then 1.0D when not hh and not hl then -1.0D else 0.0D end as bias from j""",
        bars=_numbered(bars),
    )


def zone_notes(zones: DataFrame, outlook: DataFrame, ends: DataFrame, near_fib: float = 0.03, near_mean: float = 0.025) -> DataFrame:
    """Adds ``notes`` to zones ``symbol, price, confirmed, role``: volume, flip or turn of structure, the first Fibonacci
    level and the first mean that lie near; parts without ground are left out.

    ``outlook`` as of :func:`market_structure`; ``ends``: ``symbol, lo, hi``.
    """
    rows = zones.join(outlook.select("symbol", *(f"sma_{p}" for p in MEANS)), "symbol", "left").join(ends.select("symbol", "lo", "hi"), "symbol", "left")
    p = F.col("price")

    def first(choices: list[tuple[str, Column]], within: float) -> Column:
        hits = [F.when(F.abs(p - v) / v < within, F.lit(name)) for name, v in choices]
        return F.coalesce(*hits)

    fib = first([(f"Fib {r:.3f}", F.col("lo") + r * (F.col("hi") - F.col("lo"))) for r in (0.236, 0.382, 0.5, 0.618, 0.786)], near_fib)
    mean = first([(f"SMA {k}", F.col(f"sma_{k}")) for k in MEANS], near_mean)
    role = F.when(F.col("role").contains("flip"), F.lit("Polarity flip")).when(F.col("role").contains("CHOCH"), F.concat(F.lit("Structure: "), "role"))
    notes = F.concat_ws(" | ", F.when(F.col("confirmed"), F.lit("Volume confirmed")), role, fib, mean)
    return rows.select(*zones.columns, notes.alias("notes"))


def summaries(outlook: DataFrame, area: DataFrame, zones: DataFrame) -> DataFrame:
    """``symbol, summary``: price, trend and structure, value area, and the nearest zone of either side, a line each."""
    near = zones.groupBy("symbol").agg(F.max(F.when(F.col("side") == "support", F.col("price"))).alias("s"), F.min(F.when(F.col("side") == "resistance", F.col("price"))).alias("r"))
    rows = outlook.join(area.select("symbol", "poc", "low", "high"), "symbol", "left").join(near, "symbol", "left")
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.col(c), 0))
    share = lambda x: F.concat(F.lit(" ("), F.format_string("%.1f", x * 100), F.lit("%)"))
    head = F.concat(F.lit("Price: "), money("last"), F.lit(" | Trend: "), "trend", F.lit(" | Structure: "), "structure")
    middle = F.concat(F.lit("POC: "), money("poc"), F.lit(" | VA: "), money("low"), F.lit("-"), money("high"))
    below = F.concat(F.lit("Nearest S: "), money("s"), share((F.col("last") - F.col("s")) / F.col("last")))
    above = F.concat(F.lit("Nearest R: "), money("r"), share((F.col("r") - F.col("last")) / F.col("last")))
    return rows.select("symbol", F.concat_ws("\n", head, middle, below, above).alias("summary"))


def method_overlaps(levels: DataFrame, within: float = 0.02) -> DataFrame:
    """Groups of at least two levels ``symbol, price, strength, method`` within a share of the lowest of the group."""
    grouped = anchored_clusters(levels, f"(x - a) / nullif(a, 0) < {within}")
    return _sql(
        """select symbol, avg(price) as price, count(*) as members, concat_ws('+', array_sort(collect_set(method))) as methods, max(strength) as strongest
           from {g} group by symbol, anchor having count(*) >= 2""",
        g=grouped,
    )


def tagged_levels(levels: DataFrame, within: float = 0.005) -> DataFrame:
    """Levels ``symbol, price, source`` chained by steps of at most a share of the last: the upper middle price, sources
    and number of each chain."""
    grouped = gap_clusters(levels, f"(x - y) / nullif(y, 0) > {within}")
    return _sql(
        """select symbol, element_at(prices, cast(members div 2 + 1 as int)) as price, members, sources from (select symbol, array_sort(collect_list(price)) as prices, count(*) as members,
             concat_ws('+', array_sort(collect_set(source))) as sources from {g} group by symbol, cluster)""",
        g=grouped,
    )


def sided(prices: Column, last: Column) -> tuple[Column, Column]:
    """Prices below ``last``, highest first, and the others, lowest first."""
    return F.reverse(F.array_sort(F.filter(prices, lambda p: p < last))), F.array_sort(F.filter(prices, lambda p: p >= last))
