"""Queries over outlooks, weekly states, formats, payloads and pooled levels, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions.prices import dollar_price, plain_price
from tidemark.functions.text import day_of, line_kind, plain_markdown, source_key
from tidemark.operators import bars as B, indicators as I, levels as L, outlook as O, scoring as C, states as S, weekly as K
from tidemark.plans.problems import _DAY
from tidemark.plans.replay import _CTX, _SOURCE, SQL as _REPLAY, _prices as _found
from tidemark.plans.series import _DIRECTIONAL, _LABEL, _RSI, AS_OF, D, H, SIX, hourly, rounded, shipped
from tidemark.plans.structure import N, SQL as _STRUCTURE, _all_levels
from tidemark.plans.zoning import BASE, _base
from tidemark.sources.tables import table


def market_outlook(spark, d):
    return rounded(O.market_structure(hourly(spark, d)))


def detector_presets(spark, d):
    """Settings for windows of 1 to 200 days."""
    rows = spark.range(1, 201).select(F.col("id").alias("days"), O.detector_preset(F.col("id")).alias("p"))
    return rows.select("days", "p.preset", "p.swing_window", "p.bins", F.concat_ws(",", F.transform("p.touch_windows", lambda w: w.cast("string"))).alias("touch_windows"), "p.least_touches")


def _ends(rows):
    return rows.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))


def zone_notes(spark, d):
    rows = hourly(spark, d)
    zones = _base(spark, d).select("symbol", "price", "side", "confirmed", F.when(F.col("touches") >= 25, "flip").when(F.col("strength") > 0.5, "CHOCH").otherwise("").alias("role"))
    return rounded(O.zone_notes(zones, O.market_structure(rows), _ends(rows)).select("symbol", "price", "side", "notes"), 4)


def outlook_summary(spark, d):
    rows = hourly(spark, d)
    return O.summaries(O.market_structure(rows), L.value_area(L.volume_profile(rows)), _base(spark, d).select("symbol", "price", "side"))


def regime_confidence(spark, d):
    rows = S.regime_confidence(hourly(spark, d))
    return rounded(rows.select("symbol", "ts", "regime", "confidence", "adx_slope", "adx_direction", "di_slope", "di_direction"), 5)


def state_transitions(spark, d):
    """The state after every combination of trend, signal, strength, state before and weeks without a break."""
    trends, signals = ["BULLISH", "BEARISH", "TRANSITIONING", "RANGING"], ["NONE", "BOS_UP", "BOS_DOWN", "CHOCH_UP", "CHOCH_DOWN"]
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), F.col(c).cast("int") + 1)
    g = spark.range(4 * 5 * 4 * 5 * 2).select(
        F.expr("id % 4").alias("t"), F.expr("id div 4 % 5").alias("s"), F.expr("id div 20 % 4").alias("strength"), F.expr("id div 80 % 5").alias("p"), F.expr("id div 400 * 4").alias("weeks")
    )
    rows = g.select(pick(trends, "t").alias("trend"), pick(signals, "s").alias("signal"), "strength", F.when(F.col("p") < 4, pick(trends, "p")).alias("prior"), "weeks")
    return rows.withColumn("state", K.next_state(F.col("trend"), F.col("signal"), F.col("strength"), F.col("prior"), F.col("weeks")))


def weekly_states(spark, d):
    asked = table(spark, d, "tokens").select("symbol").unionByName(shipped(spark, d).select("symbol"))
    return K.states(asked, B.resample(shipped(spark, d), "week", AS_OF)).drop("strength")


def pivots_apart(spark, d):
    """Weekly pivots that move at least two percent from the last one of their kind."""
    found = K.pivots(B.resample(shipped(spark, d), "week", AS_OF))
    return rounded(K.apart_pivots(found, 0.02), 5)


def detector_levels(spark, d):
    """The levels of every detector side by side."""
    return rounded(_all_levels(spark, d).select("symbol", "method", "price", "strength", "touches"), 8)


def method_overlaps(spark, d):
    return rounded(O.method_overlaps(_all_levels(spark, d)), 8)


def tagged_levels(spark, d):
    """Levels that texts name for a token, with the sources that name them, joined within half a percent."""
    docs = table(spark, d, "documents").where("symbol is not null").select("doc_id", "symbol", source_key(F.col("source")).alias("source"))
    rows = C.context_levels(table(spark, d, "documents"), "doc_id", "text").join(docs, "doc_id").where("source is not null")
    return O.tagged_levels(rows.select("symbol", "price", "source").distinct())


def sided_prices(spark, d):
    """Prices named in each text, below and from a thousand on."""
    below, above = O.sided(C.prices_in(F.col("text")), F.lit(1000.0))
    show = lambda a: F.concat_ws(" ", F.transform(a, lambda x: F.round(x, 4).cast("decimal(20,4)").cast("string")))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.filter(below, lambda x: x >= 1e-3).alias("a"), F.filter(above, lambda x: x < 1e12).alias("b"))
    return rows.select("doc_id", show(F.col("a")).alias("below"), show(F.col("b")).alias("above"))


def markdown_lines(spark, d):
    """Lines of each text by kind; between fences they are code."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "s"))
    fences = F.sum((line_kind(F.col("s")) == "fence").cast("int")).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when((F.coalesce(fences, F.lit(0)) % 2 == 1) & (line_kind(F.col("s")) != "fence"), "code").otherwise(line_kind(F.col("s")))
    return lines.withColumn("kind", kind).groupBy("doc_id", "kind").agg(F.count("*").alias("lines"), F.sum(F.length(plain_markdown(F.col("s")))).alias("characters"))


def sided_levels(spark, d):
    """Prices of texts by the word before them, others by their place below a thousand or not."""
    return C.context_levels(table(spark, d, "documents"), "doc_id", "text", F.lit(1000.0))


def price_formats(spark, d):
    rows = table(spark, d, "lineitem").select(F.try_divide("l_extendedprice", "l_quantity").alias("price")).distinct()
    sizes = rows.withColumn("price", F.explode(F.array(*(F.col("price") * k for k in (1.371723456789e-7, 1.371723456789e-5, 1.371723456789e-3, 0.01371723456789, 1.003723456789))))).distinct()
    return sizes.select("price", plain_price(F.col("price")).alias("plain"), dollar_price(F.col("price")).alias("dollars"))


def _pages(rows, entry, newest_first: bool):
    """One JSON list a symbol and day, days as pages."""
    keyed = rows.withColumn("day", F.to_date("ts")).groupBy("symbol", "day").agg(F.sort_array(F.collect_list(F.struct("ts", entry.alias("k"))), not newest_first).alias("l"))
    return keyed.select("symbol", F.col("day").alias("page"), F.transform("l", lambda x: x["k"]).alias("l"))


def _numbers(*columns: str):
    return [F.col(c).cast("string") for c in columns]


def pool_payloads(spark, d):
    """Hourly bars written as the pages of a pool source, newest first, each page with the first bar of the next, and read back."""
    entry = F.array(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), *_numbers("open", "high", "low", "close", "volume"))
    pages = _pages(hourly(spark, d), entry, True)
    body = F.to_json(F.struct(F.struct(F.struct(F.col("l").alias("ohlcv_list")).alias("attributes")).alias("data")))
    return rounded(B.pool_klines(pages.select("symbol", "page", body.alias("body"))).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def snapshot_payloads(spark, d):
    """Hourly bars written as snapshots of candle objects, a day each, and read back."""
    entry = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), *(F.col(c).cast("string").alias(k) for c, k in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))))
    pages = _pages(hourly(spark, d), entry, False)
    return rounded(B.snapshot_candles(pages.select("symbol", F.to_json("l").alias("body"))).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def paged_klines(spark, d):
    """Two sets of pages, the second with volumes one larger: of bars with one time the last page's is kept."""
    rows = hourly(spark, d)
    number = lambda v: F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), *_numbers("open", "high", "low", "close"), v.cast("string"))
    old, new = _pages(rows, number(F.col("volume")), False), _pages(rows.where("hour(ts) < 12"), number(F.col("volume") + 1), False)
    both = old.withColumn("page", F.struct(F.lit(0).alias("set"), "page")).unionByName(new.withColumn("page", F.struct(F.lit(1).alias("set"), "page")))
    return rounded(B.klines(both.select("symbol", "page", F.to_json("l").alias("body")), keep="last").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def overlap_scan(spark, d):
    rows = shipped(spark, d)
    return rounded(B.overlap_scan(B.closed_bars(rows, AS_OF), rows).select("symbol", "ts", "close"))


def min_risk_reward(spark, d):
    rows = table(spark, d, "trades").distinct()
    return rows.groupBy("run_id").agg(F.count_if(S.true(F.col("raw_rr") >= 1.2)).alias("passing"), F.count("*").alias("trades"))


def last_trades(spark, d):
    """The last twenty trades of each run."""
    rows = table(spark, d, "trades").select("run_id", "trade_id", day_of(F.col("entry_date")).alias("day"), "pnl_usd").where("day is not null").distinct()
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("day").desc(), F.col("trade_id").desc(), F.col("pnl_usd").desc_nulls_last()))
    return rows.withColumn("place", place.cast("bigint")).where("place <= 20").select("run_id", "trade_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "place")


def rsi_rounded(spark, d):
    """The simple RSI with two places, 50 where it is not known."""
    return I.rsi_simple(hourly(spark, d)).select("symbol", "ts", F.coalesce(F.round("rsi", 2), F.lit(50.0)).alias("rsi"))


QUERIES = {
    f.__name__: f
    for f in (
        market_outlook, detector_presets, zone_notes, outlook_summary, regime_confidence, state_transitions, weekly_states, pivots_apart, detector_levels, method_overlaps, tagged_levels,
        sided_prices, sided_levels, markdown_lines, price_formats, pool_payloads, snapshot_payloads, paged_klines, overlap_scan, min_risk_reward, last_trades, rsi_rounded,
    )
}

_MEANS = ", ".join(f"case when n >= {p} then avg(close) filter (i >= n - {p}) end as sma_{p}" for p in O.MEANS)
_OUT = f"""ex as (select symbol, i, top, bottom, n, max(top) over p as a, max(top) over q as b1, min(bottom) over p as c1, min(bottom) over q as d1 from b
   window p as (partition by symbol order by i rows between 10 preceding and 1 preceding), q as (partition by symbol order by i rows between 1 following and 10 following)),
 eh as (select symbol, list(top order by i desc) as h from ex where top > a and top > b1 group by 1), el as (select symbol, list(bottom order by i desc) as l from ex where bottom < c1 and bottom < d1 group by 1),
 om as (select symbol, n as bars, arg_max(close, i) as last, max(close) filter (i = n - ceil(n / 3)::bigint) as third, {_MEANS} from b group by symbol, n),
 oj as (select om.*, h[1] > h[2] as hh, l[1] > l[2] as hl from om left join eh using (symbol) left join el using (symbol)),
 outlook as (select symbol, bars, last, sma_20, sma_50, sma_100, sma_200,
   case when sma_50 is null then case when last > third then 'Bullish (ST)' else 'Bearish (ST)' end when sma_200 is null then case when last > sma_50 then 'Bullish' else 'Bearish' end
     when sma_50 > sma_200 and last > sma_50 then 'Bullish' when sma_50 < sma_200 and last < sma_50 then 'Bearish' when last > sma_50 then 'Recovering' else 'Weakening' end as trend,
   case when hh is null or hl is null then 'Undefined' when hh and hl then 'HH + HL (Bullish)' when hh then 'HH + LL (Transition)' when hl then 'LH + HL (Compression)' else 'LH + LL (Bearish)' end as structure,
   case when hh and hl then 1.0 when not hh and not hl then -1.0 else 0.0 end::double as bias from oj)"""
_FIB = "case " + " ".join(f"when abs(z.price - (lo + {r}::double * (hi - lo))) / (lo + {r}::double * (hi - lo)) < 0.03 then 'Fib {r:.3f}'" for r in (0.236, 0.382, 0.5, 0.618, 0.786)) + " end"
_SMA = "case " + " ".join(f"when abs(z.price - sma_{k}) / sma_{k} < 0.025 then 'SMA {k}'" for k in O.MEANS) + " end"
_WS = _REPLAY["weekly_structure"]
_U9 = _STRUCTURE["ensemble_levels"].split(",\n m as (select symbol, min(price) as a from u9")[0]
_NEXT = """case when prior is null then trend
  when prior = 'TRANSITIONING' then case when signal = 'BOS_UP' then 'BULLISH' when signal = 'BOS_DOWN' then 'BEARISH' when weeks >= 4 then 'RANGING' else 'TRANSITIONING' end
  when prior = 'RANGING' then case when signal = 'BOS_UP' or trend = 'BULLISH' and signal = 'CHOCH_UP' then 'BULLISH' when signal = 'BOS_DOWN' or trend = 'BEARISH' and signal = 'CHOCH_DOWN' then 'BEARISH' when signal = 'NONE' then 'RANGING' else 'TRANSITIONING' end
  when prior = 'BULLISH' then case when not ends_with(signal, 'DOWN') then 'BULLISH' when signal = 'CHOCH_DOWN' and strength >= 2 then 'BEARISH' else 'TRANSITIONING' end
  else case when not ends_with(signal, 'UP') then 'BEARISH' when signal = 'CHOCH_UP' and strength >= 2 then 'BULLISH' else 'TRANSITIONING' end end"""

SQL = {
    "market_outlook": f"with {N}, {_OUT} select symbol, bars, trend, structure, bias, round(last, 6) as last, {', '.join(f'round(sma_{p}, 6) as sma_{p}' for p in O.MEANS)} from outlook",
    "detector_presets": """select days, case when days <= 30 then 'short' when days <= 90 then 'medium' else 'long' end as preset, case when days <= 30 then 3 else 5 end as swing_window, case when days <= 30 then 80 when days <= 90 then 120 else 150 end as bins,
   case when days <= 30 then '3,5,10' when days <= 90 then '5,10,20' else '5,10,20,50' end as touch_windows, case when days <= 30 then 1.0 else 1.5 end::double as least_touches from (select unnest(generate_series(1, 200)) as days)""",
    "zone_notes": f"""{BASE}, {_OUT}, fe9 as (select symbol, min(low) as lo, max(high) as hi from bars group by 1)
 select z.symbol, round(z.price, 4) as price, side, concat_ws(' | ', case when confirmed then 'Volume confirmed' end, case when touches >= 25 then 'Polarity flip' when strength > 0.5 then 'Structure: CHOCH' end, {_FIB}, {_SMA}) as notes from z join outlook using (symbol) join fe9 using (symbol)""",
    "outlook_summary": f"""{BASE}, {_OUT}, ar as ({_STRUCTURE['value_area'].replace("round(p.center, 6)", "p.center").replace("round(a.center, 6)", "a.center").replace("round(z.center, 6)", "z.center")}),
 nz as (select symbol, max(price) filter (side = 'support') as s, min(price) filter (side = 'resistance') as r from z group by 1)
 select o.symbol, concat_ws(chr(10), format('Price: ${{:,.0f}} | Trend: {{}} | Structure: {{}}', last, trend, structure), format('POC: ${{:,.0f}} | VA: ${{:,.0f}}-${{:,.0f}}', poc, low, high),
   format('Nearest S: ${{:,.0f}} ({{:.1f}}%)', s, (last - s) / last * 100), format('Nearest R: ${{:,.0f}} ({{:.1f}}%)', r, (r - last) / last * 100)) as summary from outlook o left join ar using (symbol) left join nz using (symbol)""",
    "regime_confidence": _DIRECTIONAL
    + f""", c as (select symbol, ts, pdi, mdi, adx, coalesce({_LABEL}, 'UNDEFINED') as regime, coalesce(adx - lag(adx, 3) over w, 0) as a3, coalesce(pdi - mdi, 0) - lag(coalesce(pdi - mdi, 0), 3) over w as s3 from v window w as (partition by symbol order by ts)),
 e as (select *, coalesce(s3, 0) as d3, case when regime in ('BULL', 'BEAR') then (least(adx / 28.92, 1.5) + least(abs(pdi - mdi) / 5.47, 1.5)) / 3 when regime = 'NEUTRAL' then least(adx / 28.92, 1) / 2 when regime = 'TRANSITION' then 0.4 + (adx - 19.02) / 9.9 / 5
   when regime = 'RANGE' then greatest(1 - adx / 19.02, 0.1) else 0.1 end as base, greatest(-0.15, least(0.15, a3 / 20)) as lift from c)
 select symbol, ts, regime, round(greatest(0, least(1, base + case when regime in ('BULL', 'BEAR') then lift when regime = 'RANGE' then -lift else 0 end)), 5) as confidence, round(a3, 5) as adx_slope, round(d3, 5) as di_slope,
   case when a3 > 0.5 then 'up' when a3 < -0.5 then 'down' else 'flat' end as adx_direction, case when d3 > 0.5 then 'up' when d3 < -0.5 then 'down' else 'flat' end as di_direction from e""",
    "state_transitions": f"""with g as (select trend, signal, strength, prior, weeks from (select unnest(['BULLISH', 'BEARISH', 'TRANSITIONING', 'RANGING']) as trend), (select unnest(['NONE', 'BOS_UP', 'BOS_DOWN', 'CHOCH_UP', 'CHOCH_DOWN']) as signal),
   (select unnest(generate_series(0, 3)) as strength), (select unnest(['BULLISH', 'BEARISH', 'TRANSITIONING', 'RANGING', null]) as prior), (select unnest([0, 4]) as weeks)) select *, {_NEXT} as state from g""",
    "weekly_states": f"""with {D}, asked as (select symbol from tokens union select symbol from bars), wb9 as (select symbol, count(*) as n from (select symbol, date_trunc('week', ts) as w from bars group by 1, 2 having date_trunc('week', ts) + interval 7 day <= timestamp '{AS_OF}') group by 1), ws as ({_WS})
 select symbol, case when wb9.n is null then 'UNKNOWN' when ws.trend is null then 'INSUFFICIENT_DATA' else ws.trend end as state, coalesce(sequence, '') as sequence, coalesce(signal, 'NONE') as signal, coalesce(wb9.n, 0) as bars,
   case when wb9.n is null then 'no bars' when ws.trend is null then 'only ' || wb9.n || ' closed weeks, 16 needed' end as error from asked left join wb9 using (symbol) left join ws using (symbol) where symbol is not null""",
    "detector_levels": f"{_U9} select symbol, method, round(price, 8) as price, round(strength, 8) as strength, touches from u9",
    "method_overlaps": f"""{_U9}, mo as (select symbol, min(price) as a from u9 group by 1 union all select mo.symbol, (select min(price) from u9 where u9.symbol = mo.symbol and (price - mo.a) / mo.a >= 0.02) from mo where mo.a is not null),
 og as (select *, (select max(mo.a) from mo where mo.symbol = u9.symbol and mo.a <= price) as anchor from u9)
 select symbol, round(avg(price), 8) as price, count(*) as members, string_agg(distinct method, '+' order by method) as methods, round(max(strength), 8) as strongest from og group by symbol, anchor having count(*) >= 2""",
    "tagged_levels": f"""with {_CTX}, v as (select distinct symbol, price, {_SOURCE} as source from ctx join documents using (doc_id) where symbol is not null and {_SOURCE} is not null),
 u as (select symbol, price, lag(price) over (partition by symbol order by price) as y from (select distinct symbol, price from v)), g as (select symbol, price, sum(case when y is null or (price - y) / y > 0.005 then 1 else 0 end) over (partition by symbol order by price) as g from u)
 select symbol, list(price order by price)[count(*) // 2 + 1] as price, count(*) as members, string_agg(distinct source, '+' order by source) as sources from v join g using (symbol, price) group by symbol, g.g""",
    "sided_prices": f"""with p as (select doc_id, unnest({_found('text')}) as p from documents where text is not null), q as (select distinct doc_id, try_cast(replace(p, ',', '') as double) as x from p),
 s as (select doc_id, string_agg(round(x, 4)::decimal(20,4)::varchar, ' ' order by x desc) filter (x < 1000 and x >= 1e-3) as a, string_agg(round(x, 4)::decimal(20,4)::varchar, ' ' order by x) filter (x >= 1000 and x < 1e12) as b from q where x > 0 group by 1)
 select doc_id, coalesce(a, '') as below, coalesce(b, '') as above from documents left join s using (doc_id) where text is not null""",
    "sided_levels": f"with {_CTX} select distinct doc_id, case when side <> 'unknown' then side when price < 1000 then 'support' else 'resistance' end as side, price from ctx",
    "markdown_lines": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as s, unnest(generate_series(1, len(string_split(text, chr(10))))) as k from documents where text is not null),
 t as (select *, regexp_replace(s, '^[ \t\r]+|[ \t\r]+$', '', 'g') as bare from l), x as (select doc_id, k, s, case when starts_with(bare, '```') then 'fence' when starts_with(s, '# ') then 'title' when starts_with(s, '## ') then 'section' when starts_with(s, '### ') then 'part' when starts_with(s, '#### ') then 'point'
   when bare = '---' then 'rule' when starts_with(bare, '- ') or starts_with(bare, '* ') then 'bullet' when regexp_matches(s, '^[ \t]*[0-9]+\.[ \t]+[^ \t\r]') then 'item' when starts_with(s, '|') then 'row' when bare = '' then 'blank' else 'text' end as kind from t),
 f as (select *, coalesce(sum(case when kind = 'fence' then 1 else 0 end) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) % 2 as inside from x)
 select doc_id, case when inside = 1 and kind <> 'fence' then 'code' else kind end as kind, count(*) as lines, sum(length(regexp_replace(regexp_replace(regexp_replace(s, '\*\*([^\n]+?)\*\*', '\1', 'g'), '\*([^\n]+?)\*', '\1', 'g'), '`([^\n]+?)`', '\1', 'g')))::bigint as characters from f group by all""",
    "price_formats": """with r as (select distinct l_extendedprice / l_quantity as p from lineitem), x as (select distinct p * unnest([1.371723456789e-7, 1.371723456789e-5, 1.371723456789e-3, 0.01371723456789, 1.003723456789]::double[]) as price from r)
 select price, case when price >= 1000 then format('{:,.2f}', price) when price >= 1 then format('{:.4f}', price) else format('{:.6f}', price) end as plain,
   case when price >= 1000 then format('${:,.0f}', price) when price >= 10 then format('${:,.1f}', price) when price >= 1 then format('${:,.2f}', price) when price >= 0.01 then format('${:,.4f}', price) when price >= 0.0001 then format('${:,.6f}', price) else format('${:,.8f}', price) end as dollars from x""",
    "pool_payloads": f"with {H} select symbol, ts, {SIX} from bars",
    "snapshot_payloads": f"with {H} select symbol, ts, {SIX} from bars",
    "paged_klines": f"with {H} select symbol, ts, {SIX.replace('round(volume, 6)', 'case when hour(ts) < 12 then volume + 1 else volume end')} from bars",
    "overlap_scan": f"with {D}, l as (select symbol, max(ts)::date - 2 as f from bars where ts < timestamp '{AS_OF}' group by 1) select symbol, ts, round(close, 6) as close from bars left join l using (symbol) where f is null or ts::date >= f",
    "min_risk_reward": "select run_id, count(*) filter (coalesce(raw_rr >= 1.2, false)) as passing, count(*) as trades from (select distinct * from trades) group by 1",
    "last_trades": f"""with t as (select distinct run_id, trade_id, {_DAY.format('entry_date')} as day, pnl_usd from trades), r as (select *, row_number() over (partition by run_id order by day desc, trade_id desc, pnl_usd desc nulls last) as place from t where day is not null)
 select run_id, trade_id, strftime(day, '%Y-%m-%d') as day, place from r where place <= 20""",
    "rsi_rounded": f"with {H}, {_RSI} select symbol, ts, coalesce(round(rsi, 2), 50) as rsi from rsi",
}
