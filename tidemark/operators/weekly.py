"""Market structure on weekly bars: confirmed pivots, their sequence, breaks and the state they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.levels import _numbered, _sql


def pivots(bars: DataFrame, k: int = 2) -> DataFrame:
    """Body highs and lows that exceed ``k`` bars on both sides; known ``k`` bars later (``confirmed_on``)."""
    return _sql(
        f"""select symbol, i, ts, kind, price, confirmed_on from (select symbol, i, ts, stack(2, 'high', top, top > pt and top > nt, 'low', bottom, bottom < pb and bottom < nb) as (kind, price, hit), confirmed_on
              from (select *, max(top) over p as pt, max(top) over q as nt, min(bottom) over p as pb, min(bottom) over q as nb, lead(ts, {k}) over (partition by symbol order by i) as confirmed_on from {{b}}
                window p as (partition by symbol order by i rows between {k} preceding and 1 preceding), q as (partition by symbol order by i rows between 1 following and {k} following))
              where i >= {k} and i < n - {k}) where hit""",
        b=_numbered(bars),
    )


def structure(bars: DataFrame, k: int = 2, keep: int = 4, least: int = 16, beyond: float = 0.003, stale: int = 6, stale_move: float = 0.10) -> DataFrame:
    """For each symbol with at least ``least`` bars: sequence of its last two pivots of either kind (HH+HL and so on),
    trend, and whether the last body breaks the last pivot high (tested first) or low: BOS with the trend or out of a
    range, CHOCH otherwise. A signal needs a pivot of either kind. ``trend`` is the state seen before the signal.

    Where the last pivot of a kind was confirmed ``stale`` weeks ago or earlier and the last body lies ``stale_move`` beyond
    it, the extreme body of the last ``stale`` bars becomes the last pivot, confirmed by the last bar. ``strength`` of a
    signal, 0 to 3: two pivots of either kind, body 1 % beyond the pivot, body as large as the mean true range of ten
    bars. ``weeks_in_state``: weeks since the last pivot was confirmed, 0 unless there are both kinds.
    """
    return _sql(
        f"""with r as (select *, row_number() over (partition by symbol, kind order by i desc) as age from {{p}}),
            s as (select symbol, max(if(kind = 'high' and age = 1, price, null)) as ph1, max(if(kind = 'high' and age = 2, price, null)) as ph2, max(if(kind = 'low' and age = 1, price, null)) as pl1,
                max(if(kind = 'low' and age = 2, price, null)) as pl2, max(if(kind = 'high' and age = 1, confirmed_on, null)) as ph_on, max(if(kind = 'low' and age = 1, confirmed_on, null)) as pl_on, count_if(age <= {keep}) as pivots from r group by symbol),
            w as (select *, greatest(high - low, abs(high - lag(close) over (partition by symbol order by i)), abs(low - lag(close) over (partition by symbol order by i))) as tr from {{b}}),
            c as (select symbol, max_by(close, i) as last, max_by(top, i) as top, max_by(bottom, i) as bottom, max(n) as n, max(ts) as as_of, max(if(i >= n - {stale}, top, null)) as peak, min(if(i >= n - {stale}, bottom, null)) as trough,
                if(max(n) > 10, avg(if(i >= n - 10, tr, null)), null) as atr from w group by symbol),
            m as (select c.*, s.* except (symbol), coalesce(datediff(as_of, ph_on) div 7 >= {stale} and (top - ph1) / ph1 >= {stale_move} and peak > ph1, false) as stale_high,
                coalesce(datediff(as_of, pl_on) div 7 >= {stale} and (pl1 - bottom) / pl1 >= {stale_move} and trough < pl1, false) as stale_low from c left join s on s.symbol = c.symbol where n >= {least}),
            f as (select *, if(stale_high, peak, ph1) as h1, if(stale_high, ph1, ph2) as h2, if(stale_low, trough, pl1) as l1, if(stale_low, pl1, pl2) as l2, if(stale_high, as_of, ph_on) as h_on, if(stale_low, as_of, pl_on) as l_on from m),
            q as (select *, case when h2 is null or l2 is null then 'Incomplete' else concat(if(h1 > h2, 'HH', 'LH'), '+', if(l1 > l2, 'HL', 'LL')) end as sequence from f),
            t as (select *, case sequence when 'HH+HL' then 'BULLISH' when 'LH+LL' then 'BEARISH' when 'Incomplete' then 'RANGING' else 'TRANSITIONING' end as trend from q),
            g as (select *, case when h1 is null or l1 is null then 'NONE' when top > h1 * (1 + {beyond}) then if(trend in ('BULLISH', 'RANGING'), 'BOS_UP', 'CHOCH_UP') when bottom < l1 * (1 - {beyond}) then if(trend in ('BEARISH', 'RANGING'), 'BOS_DOWN', 'CHOCH_DOWN') else 'NONE' end as signal from t)
            select symbol, n as bars, as_of, sequence, trend, h1 as last_high, l1 as last_low, coalesce(pivots, 0) + cast(stale_high as bigint) + cast(stale_low as bigint) as pivots, signal,
              if(signal = 'NONE', 0, if(h2 is not null and l2 is not null, 1, 0) + if(if(endswith(signal, 'UP'), (top - h1) / h1, (l1 - bottom) / l1) >= 0.01, 1, 0) + if(coalesce(atr > 0 and top - bottom >= atr, false), 1, 0)) as strength,
              if(h1 is null or l1 is null, 0, greatest(0, datediff(as_of, greatest(h_on, l_on)) div 7)) as weeks_in_state from g""",
        p=pivots(bars, k),
        b=_numbered(bars),
    )


def next_state(trend: Column, signal: Column, strength: Column, prior: Column, weeks_without_break: Column) -> Column:
    """State after a week from the trend of its sequence, its signal and the state before (null: none yet).

    A turn against a trend leads through TRANSITIONING unless the signal is strong (2 or more); a transition ends with a
    break of structure, or in RANGING after four weeks without one.
    """
    up, down = F.lit("BULLISH"), F.lit("BEARISH")
    turn, flat = F.lit("TRANSITIONING"), F.lit("RANGING")

    def trending(here: Column, there: Column, against: str) -> Column:
        return F.when((signal == f"CHOCH_{against}") & (strength >= 2), there).when(signal.isin(f"CHOCH_{against}", f"BOS_{against}"), turn).otherwise(here)

    ranging = (
        F.when((signal == "BOS_UP") | ((trend == "BULLISH") & (signal == "CHOCH_UP")), up)
        .when((signal == "BOS_DOWN") | ((trend == "BEARISH") & (signal == "CHOCH_DOWN")), down)
        .when(signal.startswith("CHOCH"), turn)
        .otherwise(flat)
    )
    turning = F.when(signal == "BOS_UP", up).when(signal == "BOS_DOWN", down).when(weeks_without_break >= 4, flat).otherwise(turn)
    return (
        F.when(prior == "BULLISH", trending(up, down, "DOWN")).when(prior == "BEARISH", trending(down, up, "UP")).when(prior == "TRANSITIONING", turning).when(prior == "RANGING", ranging).otherwise(trend)
    )


def states(symbols: DataFrame, bars: DataFrame, prior: DataFrame | None = None, least: int = 16) -> DataFrame:
    """``symbol, state, sequence, signal, strength, bars, error`` of every symbol asked for.

    ``prior``: ``symbol, prior, weeks_without_break`` where known; it takes the place of the trend in judging the signal. A
    symbol without bars is UNKNOWN, one with fewer than ``least`` INSUFFICIENT_DATA, each with the reason as ``error``.
    """
    asked = symbols.select("symbol").where("symbol is not null").distinct()
    have = bars.groupBy("symbol").agg(F.count("*").alias("bars"))
    known = structure(bars, least=least).select("symbol", "sequence", "trend", "signal", "strength")
    rows = asked.join(have, "symbol", "left").join(known, "symbol", "left")
    if prior is None:
        rows = rows.withColumn("prior", F.lit(None).cast("string")).withColumn("weeks_without_break", F.lit(0))
    else:
        rows = rows.join(prior.select("symbol", "prior", "weeks_without_break"), "symbol", "left")
    held = F.coalesce("prior", "trend")
    side = F.regexp_extract("signal", "(UP|DOWN)$", 1)
    with_it = F.when(side == "UP", held.isin("BULLISH", "RANGING")).otherwise(held.isin("BEARISH", "RANGING"))
    signal = F.when(side == "", F.col("signal")).otherwise(F.concat(F.when(with_it, "BOS_").otherwise("CHOCH_"), side))
    rows = rows.withColumn("signal", signal)
    state = next_state(F.col("trend"), F.col("signal"), F.col("strength"), F.col("prior"), F.coalesce("weeks_without_break", F.lit(0)))
    count = F.coalesce("bars", F.lit(0))
    error = F.when(count == 0, F.lit("no bars")).when(F.col("trend").isNull(), F.concat(F.lit("only "), count.cast("string"), F.lit(f" closed weeks, {least} needed")))
    return rows.select(
        "symbol", F.when(count == 0, "UNKNOWN").when(F.col("trend").isNull(), "INSUFFICIENT_DATA").otherwise(state).alias("state"), F.coalesce("sequence", F.lit("")).alias("sequence"),
        F.coalesce("signal", F.lit("NONE")).alias("signal"), F.coalesce(F.col("strength").cast("bigint"), F.lit(0)).alias("strength"), count.cast("bigint").alias("bars"), error.alias("error"),
    )


def apart_pivots(found: DataFrame, least_move: float) -> DataFrame:
    """Pivots in order without those that move less than a share from the last kept one of their kind; one that goes
    further without moving so much takes its place. A fold over a symbol's pivots in one array."""
    turn = lambda kind, op: f"""case when s.{kind} is null or abs(x.price - s.{kind}.price) / s.{kind}.price >= {least_move} then named_struct('kept', concat(s.kept, array(x)), 'high', {'x' if kind == 'high' else 's.high'}, 'low', {'x' if kind == 'low' else 's.low'})
        when x.price {op} s.{kind}.price then named_struct('kept', concat(filter(s.kept, v -> not (v.i = s.{kind}.i and v.kind = '{kind}')), array(x)), 'high', {'x' if kind == 'high' else 's.high'}, 'low', {'x' if kind == 'low' else 's.low'}) else s end"""  # noqa: E731
    return _sql(
        f"""select symbol, x.i as i, x.kind as kind, x.price as price, x.confirmed_on as confirmed_on from (select symbol, explode(array_sort(aggregate(all, named_struct('kept', slice(all, 1, 0), 'high', nullif(all[0], all[0]), 'low', nullif(all[0], all[0])),
              (s, x) -> if(x.kind = 'high', {turn('high', '>')}, {turn('low', '<')})).kept)) as x
            from (select symbol, row_number() over (partition by symbol order by i, kind) as nth, array_sort(collect_list(struct(confirmed_on, kind, i, price)) over (partition by symbol)) as all from {{p}}) where nth = 1)""",
        p=found,
    )
