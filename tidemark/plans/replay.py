"""Queries over replays, trade statistics, scoring, texts with levels, weekly structure and reference tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions.text import day_of, source_key, trimmed
from tidemark.operators import backtest as R, bars as B, indicators as I, levels as L, scoring as C, states as S, universe as U, weekly as K
from tidemark.plans.problems import _DAY
from tidemark.plans.series import _RSI, AS_OF, D, H, SQL as _SERIES, hourly, rounded, shipped
from tidemark.plans.structure import _FLIP, _TOUCH, ATR, N
from tidemark.sources.tables import table

STABLE = ("USDT", "USDC", "DAI")
FIXES = {"MIOTA": "IOTA"}
TARGET = 50


def _entries(spark, d):
    """A long entry at every close with RSI above 60; target and stop two percent away."""
    rows = I.rsi_simple(B.indexed(hourly(spark, d)))
    c = F.col("close")
    return rows.where("rsi > 60 and i < n - 1").select("symbol", F.col("i").alias("entry_bar"), c.alias("entry_price"), (c * 1.02).alias("take_profit"), (c * 0.98).alias("stop_loss"))


def first_hit_exit(spark, d):
    return rounded(R.first_hits(_entries(spark, d), hourly(spark, d)))


def backtest_single(spark, d):
    return rounded(R.one_at_a_time(R.first_hits(_entries(spark, d), hourly(spark, d))))


def backtest_pooled(spark, d):
    """Two strategies over one book each: one and two slots differ by threshold only, ranked by RSI, entered at the next open."""
    rows = I.rsi_simple(hourly(spark, d))
    c = F.col("close")
    picks = F.explode(F.array(F.struct(F.lit("rsi_60").alias("strategy"), F.lit(60.0).alias("least")), F.struct(F.lit("rsi_70").alias("strategy"), F.lit(70.0).alias("least"))))
    signals = rows.withColumn("x", picks).where("rsi > x.least").select("x.strategy", "symbol", "ts", F.col("rsi").alias("rank"), (c * 1.02).alias("take_profit"), (c * 0.98).alias("stop_loss"))
    return rounded(R.pooled(signals, hourly(spark, d)))


def backtest_hourly(spark, d):
    """Hourly entries above the last daily close and an RSI of 60; two slots, ten days at most, a day's pause after an exit."""
    rows = hourly(spark, d)
    known = I.rsi_simple(rows).where("rsi > 60").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "rsi")
    picked = known.join(asof_daily_to_hourly(spark, d), ["symbol", "ts"]).where("close > day_close")
    c = F.col("close")
    signals = picked.select(F.lit("hourly").alias("strategy"), "symbol", "ts", F.col("rsi").alias("rank"), (c * 1.02).alias("take_profit"), (c * 0.98).alias("stop_loss"))
    return rounded(R.pooled(signals, rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")), hold=240, slots=2, cool_down_hours=24))


def _trades(spark, d):
    return table(spark, d, "trades").distinct()


def trade_stats(spark, d):
    rows = _trades(spark, d).join(table(spark, d, "backtest_runs").select("run_id", "strategy"), "run_id")
    return R.trade_statistics(rows.withColumn("symbol", F.upper(trimmed(F.col("symbol")))), ["strategy", "symbol"])


def monthly_pivot(spark, d):
    rows = _trades(spark, d).withColumn("day", day_of(F.col("exit_date"))).where("day is not null")
    return R.monthly(rows, "day")


def equity_drawdown(spark, d):
    rows = _trades(spark, d).withColumn("day", day_of(F.col("exit_date"))).where("day is not null and pnl_usd is not null")
    return R.drawdown(rows, "run_id", ["day", "trade_id"])


def fee_grid(spark, d):
    return R.fee_grid(_trades(spark, d).where("pnl_usd is not null"), "run_id")


def btc_floor_join(spark, d):
    """Bars of every symbol at times at which the market's RSI is at least 50."""
    rows = I.rsi_simple(hourly(spark, d))
    floor = rows.where("symbol = 'view' and rsi >= 50").select("ts", F.col("rsi").alias("market_rsi"))
    return rounded(rows.where("symbol <> 'view'").join(floor, "ts").select("symbol", "ts", "close", "market_rsi"))


def asof_daily_to_hourly(spark, d):
    """Every hourly bar with the last daily close strictly before its day: days are carried forward by a window over the
    union of both, so the join needs no range condition."""
    rows = hourly(spark, d)
    days = B.resample(rows, "day").select("symbol", F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz").alias("at"), F.col("close").alias("day_close"), F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    bars = rows.select("symbol", F.col("ts").cast("timestamp_ntz").alias("at"), F.lit(None).cast("double").alias("day_close"), F.lit(1).alias("kind"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    w = Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = days.unionByName(bars).withColumn("day_close", F.last("day_close", ignorenulls=True).over(w))
    return rounded(out.where("kind = 1").select("symbol", "ts", "day_close"))


def _levels(spark, d):
    return L.touch_levels(hourly(spark, d)).withColumn("pos", F.row_number().over(Window.partitionBy("symbol", "side").orderBy("price"))).select("symbol", "side", "price", "pos")


def _references(spark, d):
    return L.flip_levels(hourly(spark, d), I.atr_last(hourly(spark, d)).withColumn("atr", F.col("atr") / 100)).select("symbol", "side", "price")


def ref_match_f1(spark, d):
    return C.match_scores(_levels(spark, d), _references(spark, d), 0.2)


def missed_refs(spark, d):
    return rounded(C.missed(_levels(spark, d), _references(spark, d), 0.2), 4)


def price_extract(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", C.prices_in(F.col("text")).alias("prices"))
    return rows.select("doc_id", F.explode("prices").alias("price"))


def context_levels(spark, d):
    return C.context_levels(table(spark, d, "documents"), "doc_id", "text")


def level_consensus(spark, d):
    """Levels of each token that sources name under the word support or resistance, where they agree within three percent."""
    docs = table(spark, d, "documents").where("symbol is not null").select("doc_id", "symbol", source_key(F.col("source")).alias("source"))
    rows = C.context_levels(table(spark, d, "documents"), "doc_id", "text").where("side <> 'unknown'").join(docs, "doc_id").where("source is not null")
    return C.consensus(rows.select("symbol", "side", "price", "source").distinct())


def pivots_confirmed(spark, d):
    rows = K.pivots(B.resample(shipped(spark, d), "week", AS_OF))
    return rounded(rows.select("symbol", "i", "kind", "price", "confirmed_on"), 5)


def weekly_structure(spark, d):
    rows = K.structure(B.resample(shipped(spark, d), "week", AS_OF))
    return rounded(rows.select("symbol", "bars", "sequence", "trend", "last_high", "last_low", "pivots", "signal"), 4)


def weekly_signals(spark, d):
    """Signal of the last week with its strength, and the weeks in the present state."""
    rows = K.structure(B.resample(shipped(spark, d), "week", AS_OF))
    return rows.select("symbol", "as_of", "signal", F.col("strength").cast("bigint").alias("strength"), F.col("weeks_in_state").cast("bigint").alias("weeks_in_state"))


def gated_regimes(spark, d):
    """Three-view regimes with a table of gates: open where no view is down."""
    states = S.three_timeframes(hourly(spark, d))
    gates = states.select("gate_key").distinct().withColumn("gate", ~F.col("gate_key").contains("D"))
    return S.gated(states, gates).groupBy("symbol").agg(F.count_if("gate").alias("open_bars"), F.count("ts").alias("bars"))


def token_universe(spark, d):
    """The first ranked tokens without stable ones or malformed symbols; tokens that candle tables know come first."""
    known = table(spark, d, "feeds").select("symbol")
    return U.token_universe(table(spark, d, "tokens"), known, STABLE, FIXES, TARGET)


def tier_check(spark, d):
    """Tokens by tier; the sets of the three tiers, each with the smaller ones, and symbols of a tier the next one lacks."""
    t = table(spark, d, "tokens")
    members = U.tier_sets(t)
    return U.tier_inclusion(members)


def event_props(spark, d):
    """Nested JSON access: keys of the events' properties and how often they occur."""
    rows = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"))


def content_drift(spark, d):
    """Documents of the first and second half by content hash: only in one of them, or in both."""
    docs = table(spark, d, "documents").where("text is not null").select((F.col("doc_id") % 2).alias("half"), F.sha2("text", 256).alias("h")).distinct()
    a, b = docs.where("half = 0").select("h", F.lit(1).alias("a")), docs.where("half = 1").select("h", F.lit(1).alias("b"))
    state = F.when(F.col("a").isNull(), "second only").when(F.col("b").isNull(), "first only").otherwise("same")
    return a.join(b, "h", "full").groupBy(state.alias("state")).agg(F.count("h").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        first_hit_exit, backtest_single, backtest_pooled, backtest_hourly, trade_stats, monthly_pivot, equity_drawdown, fee_grid, btc_floor_join, asof_daily_to_hourly, ref_match_f1, missed_refs,
        price_extract, context_levels, level_consensus, pivots_confirmed, weekly_structure, weekly_signals, gated_regimes, token_universe, tier_check, event_props, content_drift,
    )
}

_ENTRY = f"""{N}, {_RSI.replace('from bars)', 'from bars)')}, en as (select b.symbol, b.i as entry_bar, b.close as entry_price, b.close * 1.02::double as take_profit, b.close * 0.98::double as stop_loss from rsi join b using (symbol, ts) where rsi > 60 and b.i < b.n - 1),
 h as (select en.*, b.i, b.close, b.low <= stop_loss as st, b.high >= take_profit as re from en join b on b.symbol = en.symbol and b.i between entry_bar + 1 and entry_bar + 7),
 x as (select *, row_number() over (partition by symbol, entry_bar order by case when st or re then 0 else 1 end, case when st or re then i else -i end) as r from h),
 tr as (select symbol, entry_bar, entry_price, take_profit, stop_loss, i as exit_bar, case when st then stop_loss when re then take_profit else close end as exit_price, case when st then 'SL' when re then 'TP' else 'TIMEOUT' end as exit_reason from x where r = 1)"""
_OUT = "symbol, entry_bar, round(entry_price, 6) as entry_price, round(take_profit, 6) as take_profit, round(stop_loss, 6) as stop_loss, exit_bar, round(exit_price, 6) as exit_price, exit_reason"
_LV = f"{N}, {ATR}, {_TOUCH}, {_FLIP}, fd as (select symbol, side, price, row_number() over (partition by symbol, side order by price) as pos from touch), rf as (select symbol, side, price from flips)"
_PAT = [
    r"(?im)\$[\s]*([\d,]+(?:\.\d+)?)", r"(?im)([\d,]+(?:\.\d+)?)\s*(?:USD|USDT)", r"(?im)(?:^|\n)\s*-?\s*\$?([\d,]+(?:\.\d+)?)\s*$", r"(?im)(?:at|around|near|level|price)\s*\$?([\d,]+(?:\.\d+)?)",
]


def _prices(text: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({text}, '{p}', 1)" for p in _PAT) + ")"


_CTX = f"""ln as (select doc_id, unnest(string_split_regex(text, '[|\\n]')) as s, unnest(generate_series(1, len(string_split_regex(text, '[|\\n]')))) as k from documents where text is not null),
 cx as (select doc_id, k, s, coalesce(last_value(case when contains(lower(s), 'support') then 'support' when contains(lower(s), 'resistance') then 'resistance' end ignore nulls) over (partition by doc_id order by k rows unbounded preceding), 'unknown') as side from ln),
 px as (select doc_id, side, unnest({_prices('s')}) as p from cx), ctx as (select distinct doc_id, side, try_cast(replace(p, ',', '') as double) as price from px where try_cast(replace(p, ',', '') as double) > 0)"""
_SOURCE = r"nullif(regexp_replace(lower(regexp_replace(source, '^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$', '', 'g')), '[\s\-]+', '_', 'g'), '')"
_WK = f"""wk as (select symbol, date_trunc('week', ts)::timestamp as ts, arg_min(open, ts) as open, arg_max(close, ts) as close from bars group by 1, date_trunc('week', ts) having date_trunc('week', ts) + interval 7 day <= timestamp '{AS_OF}'),
 wb as (select symbol, ts, close, greatest(open, close) as t, least(open, close) as b, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from wk),
 w2 as (select *, lag(t) over w as t1, lag(t, 2) over w as t2, lead(t) over w as t3, lead(t, 2) over w as t4, lag(b) over w as b1, lag(b, 2) over w as b2, lead(b) over w as b3, lead(b, 2) over w as b4, lead(ts, 2) over w as confirmed_on from wb window w as (partition by symbol order by ts)),
 pv as (select symbol, i, 'high' as kind, t as price, confirmed_on from w2 where t > t1 and t > t2 and t > t3 and t > t4 union all select symbol, i, 'low', b, confirmed_on from w2 where b < b1 and b < b2 and b < b3 and b < b4)"""

_MTF = _SERIES["mtf_regimes"]

SQL = {
    "first_hit_exit": f"with {_ENTRY} select {_OUT} from tr",
    "backtest_single": f"""with recursive {_ENTRY}, go as (select symbol, min(entry_bar) as entry_bar from tr group by 1 union all select go.symbol, (select min(t.entry_bar) from tr t where t.symbol = go.symbol and t.entry_bar >= o.exit_bar and t.entry_bar > go.entry_bar) as entry_bar
   from go join tr o on o.symbol = go.symbol and o.entry_bar = go.entry_bar) select {_OUT} from tr semi join go using (symbol, entry_bar)""",
    "trade_stats": r"""with t as (select distinct * from trades), j as (select t.*, strategy, upper(regexp_replace(symbol, '^\s+|\s+$', '', 'g')) as sym from t join backtest_runs using (run_id))
 select strategy, sym as symbol, count(*) as trades, count(*) filter (exit_reason = 'TP') as targets, count(*) filter (exit_reason = 'SL') as stops, count(*) filter (exit_reason = 'TIMEOUT') as timeouts, round(count(*) filter (exit_reason = 'TP') / count(*), 6) as win_rate_all,
   round(case when count(*) filter (exit_reason in ('TP', 'SL')) > 0 then count(*) filter (exit_reason = 'TP') / count(*) filter (exit_reason in ('TP', 'SL')) end, 6) as win_rate_decided, round(avg(pnl_pct), 8) as mean_pct, round(avg(hold_days), 6) as mean_hold,
   round(sum(cast(pnl_usd as decimal(28,6)))::double, 4) as gain from j group by rollup (strategy, sym)""",
    "monthly_pivot": f"""with t as (select distinct * from trades), d as (select *, {_DAY.format('exit_date')} as day from t) select strftime(day, '%Y-%m') as month, count(*) filter (exit_reason = 'TP') as "TP", count(*) filter (exit_reason = 'SL') as "SL", count(*) filter (exit_reason = 'TIMEOUT') as "TIMEOUT" from d where day is not null group by 1""",
    "equity_drawdown": f"""with t as (select distinct * from trades), d as (select *, {_DAY.format('exit_date')} as day from t), e as (select run_id, day, trade_id, 1000 + sum(cast(pnl_usd as decimal(28,6))) over (partition by run_id order by day, trade_id rows unbounded preceding)::double as e from d where day is not null and pnl_usd is not null),
 p as (select *, greatest(1000, max(e) over (partition by run_id order by day, trade_id rows unbounded preceding)) as p from e) select run_id, round(arg_max(e, row(day, trade_id)), 4) as equity, round(max((p - e) / p * 100), 4) as drawdown_pct from p group by 1""",
    "fee_grid": """with t as (select distinct * from trades), f as (select unnest([0.0, 0.0005, 0.001, 0.002, 0.003]::double[]) as fee), x as (select * from t, f where pnl_usd is not null)
 select run_id, fee, round(sum(cast(pnl_usd as decimal(28,6)))::double - count(*) * 100 * fee * 2, 4) as fixed, round(sum(ln(greatest(1 + (pnl_pct / 100 - 2 * fee), 1e-12))), 4) as log_growth from x group by 1, 2""",
    "btc_floor_join": f"with {H}, {_RSI} select a.symbol, a.ts, round(a.close, 6) as close, round(m.rsi, 6) as market_rsi from rsi a join rsi m on m.ts = a.ts and m.symbol = 'view' and m.rsi >= 50 where a.symbol <> 'view'",
    "asof_daily_to_hourly": f"with {H}, dd as (select symbol, date_trunc('day', ts) as day, arg_max(close, ts) as c from bars group by 1, date_trunc('day', ts)) select b.symbol, b.ts, round(c, 6) as day_close from bars b asof left join dd on dd.symbol = b.symbol and date_trunc('day', b.ts) > dd.day",
    "ref_match_f1": f"""with {_LV}, m as (select r.symbol, r.side, r.price, arg_min(f.price, f.pos) as hit from rf r join fd f on f.symbol = r.symbol and f.side = r.side and abs(f.price - r.price) / greatest(r.price, 1) * 100 <= 0.2 group by all),
 hh as (select symbol, count(*) as hits, count(distinct row(side, hit)) as good from m group by 1), nf as (select symbol, count(*) as found from fd group by 1), nr as (select symbol, count(*) as refs from rf group by 1)
 select nr.symbol, refs, coalesce(found, 0) as found, coalesce(hits, 0) as hits, round(coalesce(hits, 0) / refs, 3) as recall, round(coalesce(good / found, 0), 3) as precision, round(coalesce(2 * (good / found) * (hits / refs) / (good / found + hits / refs), 0), 3) as f1 from nr left join nf using (symbol) left join hh using (symbol)""",
    "missed_refs": f"with {_LV} select symbol, side, round(price, 4) as price from rf r where not exists (select 1 from fd f where f.symbol = r.symbol and abs(f.price - r.price) / greatest(r.price, 1) * 100 <= 0.2)",
    "price_extract": f"with p as (select doc_id, unnest({_prices('text')}) as p from documents) select distinct doc_id, try_cast(replace(p, ',', '') as double) as price from p where try_cast(replace(p, ',', '') as double) > 0",
    "context_levels": f"with {_CTX} select * from ctx",
    "level_consensus": f"""with {_CTX}, v as (select distinct symbol, side, price, {_SOURCE} as source from ctx join documents using (doc_id) where side <> 'unknown' and symbol is not null and {_SOURCE} is not null),
 u as (select distinct symbol, side, price from v), g as (select *, sum(case when y is null or (price - y) / y * 100 > 3 then 1 else 0 end) over (partition by symbol, side order by price) as g from (select *, lag(price) over (partition by symbol, side order by price) as y from u))
 select symbol, side, round(avg(v.price), 2) as price, count(*) as members, string_agg(distinct source, '+' order by source) as sources from v join g using (symbol, side, price) group by symbol, side, g.g""",
    "pivots_confirmed": f"with {D}, {_WK} select symbol, i, kind, round(price, 5) as price, confirmed_on from pv",
    "weekly_structure": f"""with {D}, {_WK}, r as (select *, row_number() over (partition by symbol, kind order by i desc) as a from pv),
 s as (select symbol, max(price) filter (kind = 'high' and a = 1) as h1, max(price) filter (kind = 'high' and a = 2) as h2, max(price) filter (kind = 'low' and a = 1) as l1, max(price) filter (kind = 'low' and a = 2) as l2, count(*) filter (a <= 4) as pivots from r group by 1),
 c as (select symbol, arg_max(t, i) as body_top, arg_max(b, i) as body_low, count(*) as n from wb group by 1 having count(*) >= 16),
 q as (select *, case when h2 is null or l2 is null then 'Incomplete' else case when h1 > h2 then 'HH' else 'LH' end || '+' || case when l1 > l2 then 'HL' else 'LL' end end as sequence from c left join s using (symbol)),
 t as (select *, case sequence when 'HH+HL' then 'BULLISH' when 'LH+LL' then 'BEARISH' when 'Incomplete' then 'RANGING' else 'TRANSITIONING' end as trend from q)
 select symbol, n as bars, sequence, trend, round(h1, 4) as last_high, round(l1, 4) as last_low, coalesce(pivots, 0) as pivots, case when h1 is null or l1 is null then 'NONE' when body_top > h1 * 1.003::double then case when trend in ('BULLISH', 'RANGING') then 'BOS_UP' else 'CHOCH_UP' end when body_low < l1 * 0.997::double then case when trend in ('BEARISH', 'RANGING') then 'BOS_DOWN' else 'CHOCH_DOWN' end else 'NONE' end as signal from t""",
    "token_universe": f"""with t as (select id, case upper(trim(symbol)) when 'MIOTA' then 'IOTA' else upper(trim(symbol)) end as symbol, market_cap_rank, tier from tokens),
 g as (select *, row_number() over (partition by symbol order by market_cap_rank, id) as r from t where length(symbol) > 1 and not contains(symbol, '_') and market_cap_rank is not null and symbol not in {STABLE}),
 k as (select *, exists (select 1 from feeds f where upper(trim(f.symbol)) = g.symbol) as known from g where r = 1)
 select symbol, market_cap_rank, tier, known from k order by known desc, market_cap_rank, symbol limit {TARGET}""",
    "tier_check": """with k as (select upper(trim(symbol)) as s, case tier when 'top_3' then 1 when 'selected' then 2 else 3 end as k from tokens where nullif(trim(symbol), '') is not null),
 m as (select distinct 'top_3' as tier, 1 as o, s from k where k = 1 union select distinct 'selected', 2, s from k where k <= 2 union select distinct 'all', 3, s from k)
 select tier, count(*) as members, count(*) filter (not exists (select 1 from m b where b.o = a.o + 1 and b.s = a.s) and o < 3) as missing_above from m a group by tier""",
    "gated_regimes": "with r as (" + _MTF + ") select symbol, count(*) filter (not contains(gate_key, 'D')) as open_bars, count(*) as bars from r group by 1",
    "event_props": "with k as (select unnest(json_keys(props)) as key from events) select key, count(*) as n from k group by 1",
    "content_drift": """with h as (select doc_id % 2 as half, sha256(text) as h from documents where text is not null), g as (select h, bool_or(half = 0) as a, bool_or(half = 1) as b from h group by 1)
 select case when not a then 'second only' when not b then 'first only' else 'same' end as state, count(*) as n from g group by 1""",
}
SQL["weekly_signals"] = f"""with {D}, {_WK}, r as (select *, row_number() over (partition by symbol, kind order by i desc) as a from pv),
 s as (select symbol, max(price) filter (kind = 'high' and a = 1) as h1, max(price) filter (kind = 'low' and a = 1) as l1, max(confirmed_on) filter (a = 1) as last_on, count(*) filter (a = 2) as seconds from r group by 1),
 wr as (select symbol, date_trunc('week', ts)::timestamp as ts, max(high) as high, min(low) as low from bars group by 1, date_trunc('week', ts)),
 tw as (select symbol, i, n, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from wb join wr using (symbol, ts) window w as (partition by symbol order by i)),
 a10 as (select symbol, avg(tr) as atr from tw where n > 10 and i >= n - 10 group by 1), g as (select symbol, signal, split_part(signal, '_', 2) as side from ({SQL["weekly_structure"]})),
 e as (select symbol, max(ts) as as_of, arg_max(t, i) as top, arg_max(b, i) as low from wb group by 1)
 select symbol, as_of, signal, case when signal = 'NONE' then 0 else (seconds = 2)::int + (case side when 'UP' then (top - h1) / h1 else (l1 - low) / l1 end >= 0.01)::int + coalesce(atr > 0 and top - low >= atr, false)::int end::bigint as strength,
   case when h1 is null or l1 is null then 0 else greatest(0, datediff('day', last_on, as_of) // 7) end::bigint as weeks_in_state from g join e using (symbol) left join s using (symbol) left join a10 using (symbol)"""
