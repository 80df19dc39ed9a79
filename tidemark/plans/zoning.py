"""Queries over zones, targets and entry filters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import day_of
from tidemark.operators import filters as E, indicators as I, levels as L, outlook as O, pipeline as P, zones as Z
from tidemark.operators.lineage import stored
from tidemark.plans.problems import _DAY
from tidemark.plans.series import _DI, _DX, _RSI, _REGIME, _STEPS, _chain, H, daily, hourly, rounded
from tidemark.plans.structure import _TOUCH, ATR, N, _atr, _prices, levels_of

MARKET = "view"


def _base(spark, d):
    rows = hourly(spark, d)
    levels = L.touch_levels(rows).select("symbol", "price", "side", "strength", "touches", "recency")
    return Z.scored(Z.volume_confirmed(levels, rows, _atr(spark, d)))


def _small_atr(spark, d):
    return _atr(spark, d).withColumn("atr", F.col("atr") / 50)


def scored_zones(spark, d):
    return rounded(_base(spark, d).select("symbol", "price", "side", "tier", "score", "touches", "confirmed"), 4)


def body_anchor_nearest(spark, d):
    levels = _base(spark, d).select("symbol", "price", "side")
    return rounded(Z.body_anchors(levels, hourly(spark, d), _small_atr(spark, d)), 4)


def zones_merge(spark, d):
    return rounded(Z.merge_zones(_base(spark, d), _small_atr(spark, d)).drop("strength"), 4)


def sandwiched_minors(spark, d):
    atr = _small_atr(spark, d)
    return rounded(Z.drop_sandwiched(Z.merge_zones(_base(spark, d), atr), atr).select("symbol", "price", "side", "tier"), 4)


def cross_side_dedup(spark, d):
    return rounded(Z.cross_side(_base(spark, d)).select("symbol", "price", "side", "score"), 4)


def zone_rank_topk(spark, d):
    return rounded(Z.nearest_zones(_base(spark, d), _prices(spark, d)), 4)


def spaced_zones(spark, d):
    return rounded(Z.spaced_zones(_base(spark, d), _small_atr(spark, d), _prices(spark, d)), 4)


def backfilled_zones(spark, d):
    base = _base(spark, d)
    return rounded(Z.backfilled(base.where("tier = 'Major'"), base.select("symbol", "price", "strength"), _small_atr(spark, d)), 4)


def multi_window_levels(spark, d):
    """Touch levels of the last 20, 60 and 180 bars side by side; the part after the bar names the window."""
    return rounded(L.touch_levels(Z.windowed(hourly(spark, d))), 4)


def round_levels(spark, d):
    p = F.try_divide("l_extendedprice", "l_quantity")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(p.alias("price")).distinct()
    x = F.col("price")
    return rows.select("price", Z.tiered_round(x, x).alias("tiered"), Z.display_grid(x).alias("grid"), Z.round_number(x).alias("snapped"))


def tpsl_cascade(spark, d):
    levels = _base(spark, d).select("symbol", "price")
    return rounded(Z.targets_and_stops(levels, _prices(spark, d), _small_atr(spark, d)), 2)


def analysis_document(spark, d):
    near = Z.nearest_zones(_base(spark, d), _prices(spark, d))
    return Z.analysis_documents(near, _prices(spark, d), _atr(spark, d), L.value_area(L.volume_profile(hourly(spark, d))), tpsl_cascade(spark, d))


def _pipeline(spark, d, second):
    """Ensembles of three windows (weighted) and of the whole series of every daily feed, merged into zones."""
    return _from_bars(stored(daily(spark, d)), second)[0]


def _from_bars(rows, second):
    atr, last = I.atr_last(rows), rows.groupBy("symbol").agg(F.max_by("close", "ts").alias("last"), F.count("*").alias("n"))
    named = Z.windowed(rows).unionByName(rows.withColumn("symbol", F.concat("symbol", F.lit("|full"))))
    series, window = F.split(F.col("symbol"), r"\|")[0], F.split(F.col("symbol"), r"\|")[1]
    merged = L.merged_levels(levels_of(named), named.groupBy("symbol").agg(F.max_by("close", "ts").alias("last")), most=30, least=0.05)
    weight = F.create_map(*(F.lit(x) for n, _, w in Z.WINDOWS for x in (n, w)))
    found = stored(merged.withColumn("window", window).withColumn("symbol", series).withColumn("age", F.lit(0.0)))
    ensemble = found.where("window <> 'full' and place <= 15 and strength >= 0.10").withColumn("strength", F.col("strength") * F.try_element_at(weight, F.col("window")))
    outlook = O.market_structure(rows)
    area = stored(L.value_area(L.volume_profile(rows, 200)))
    levels = P.candidates(ensemble, found.where("window = 'full'"), outlook, area)
    return P.zones(stored(levels), rows, atr, outlook, second), outlook, atr, area


def zones_first(spark, d):
    return _pipeline(spark, d, False)


def zones_second(spark, d):
    return _pipeline(spark, d, True)


def token_documents(spark, d):
    """The whole analysis of every daily feed as one document."""
    found, outlook, atr, area = _from_bars(stored(daily(spark, d)), False)
    return P.documents(found, outlook, atr, area)


def rr_ranking(spark, d):
    """Targets ranked by ratio, those without last; the place is given to every row."""
    from pyspark.sql import Window

    w = Window.partitionBy("flavour").orderBy(F.coalesce("ratio", F.lit(-1.0)).desc(), "symbol")
    return tpsl_cascade(spark, d).select("flavour", "symbol", "ratio", "qualified", F.row_number().over(w).cast("bigint").alias("place"))


def _inputs(spark, d):
    return E.filter_inputs(hourly(spark, d), MARKET)


def filter_chain(spark, d):
    out = E.chain(_inputs(spark, d), ["market_rsi_floor", "rsi_momentum", "relative_volume", ("below_mean", F.col("pctb") < 0.5)])
    return out.select("symbol", "ts", "passed", F.concat_ws(",", "failed").alias("failed"))


def filter_combos_256(spark, d):
    return E.combinations(_inputs(spark, d), list(E.FILTERS)).select(F.col("combination").cast("bigint").alias("combination"), "passing")


def walk_forward_folds(spark, d):
    rows = spark.read.parquet(f"{d}/trades.parquet").select(F.col("trade_id"), day_of(F.col("entry_date")).alias("ts")).where("ts is not null").distinct()
    return E.folds(rows, 6, 6, 4).groupBy("fold").agg(F.count("*").alias("trades"))


QUERIES = {
    f.__name__: f
    for f in (
        scored_zones, body_anchor_nearest, zones_merge, sandwiched_minors, cross_side_dedup, zone_rank_topk, spaced_zones, backfilled_zones, multi_window_levels, round_levels,
        tpsl_cascade, analysis_document, zones_first, zones_second, token_documents, rr_ranking, filter_chain, filter_combos_256, walk_forward_folds,
    )
}

_SA = "sa as (select symbol, atr / 50 as atr from atr)"
BASE = f"""with recursive {N}, {ATR}, {_SA}, {_TOUCH}, usual as (select symbol, avg(volume) as usual from bars group by 1),
 vc as (select t.symbol, t.price, t.side, count(*) as hits, avg(volume) as v from touch t join atr using (symbol) join bars b on b.symbol = t.symbol and low <= t.price + atr * 0.5 and high >= t.price - atr * 0.5 group by all),
 z as (select t.*, coalesce(hits >= 2 and v > usual * 1.2, false) as confirmed, case when strength >= 0.5 or touches >= 25 then 'Major' else 'Minor' end as tier,
   strength * 10 + touches + case when coalesce(hits >= 2 and v > usual * 1.2, false) then 5 else 0 end as score from touch t join usual using (symbol) left join vc using (symbol, price, side))"""
_MERGED = """g as (select *, sum(case when y is null or price - y > atr then 1 else 0 end) over (partition by symbol order by price) as g from (select z.*, sa.atr, lag(price) over (partition by z.symbol order by price) as y from z join sa using (symbol))),
 m as (select symbol, arg_max(price, row(touches, -price)) as price, arg_max(side, row(score, -price)) as side, arg_max(tier, row(score, -price)) as tier, max(score) as score, sum(touches)::bigint as touches, bool_or(confirmed) as confirmed, count(*) as merged from g group by symbol, g.g)"""
_TPSL = """s as (select symbol, last, list(price order by price) filter (price > last) as up, list(price order by price desc) filter (price < last) as down from z join lastp using (symbol) group by 1, 2),
 f as (select * from (values ('balanced', 1.0, 1.0, 0.5, 0.5), ('conservative', 0.5, 1.5, 0.3, 0.75), ('aggressive', 2.0, 0.5, 0.75, 0.3)) as t(flavour, a, b, c, d)),
 x as (select symbol, flavour, last, atr, c, d, coalesce(list_filter(up, lambda p: p - last >= a * atr)[1], up[-1]) as tp0, coalesce(list_filter(down, lambda p: last - p >= b * atr)[1], down[-1]) as sl0 from s join sa using (symbol), f),
 k as (select symbol, flavour, last, case when tp0 - last >= c * atr then tp0 end as tp, case when last - sl0 >= d * atr then sl0 end as sl from x),
 tpsl as (select flavour, symbol, round(last, 2) as price, round(tp, 2) as take_profit, round(sl, 2) as stop_loss, case when tp is not null and sl is not null then round((tp - last) / (last - sl), 2) end as ratio,
   case when tp is not null and sl is not null then round((tp - last) / last * 100, 2) end as gain_pct, case when tp is not null and sl is not null then round((last - sl) / last * 100, 2) end as loss_pct,
   tp is not null and sl is not null as qualified, case when tp is null and sl is null then 'no target and no stop' when tp is null then 'no target' when sl is null then 'no stop' end as reason from k)"""
_FILTERS = f"""{_STEPS}, {_REGIME}, {_RSI}, {_chain('k', 's', ('tr', 'dp', 'dm'), 14, 1, 14)}, q as (select symbol, i, {_DI} from k), y as (select *, {_DX} from q), {_chain('ax', 'y', ('dx',), 14, 15, 28)},
 bb as (select symbol, ts, close, volume, count(*) over w as n, avg(close) over w as m, stddev_pop(close) over w as sd, avg(volume) over w as mv from bars window w as (partition by symbol order by ts rows between 19 preceding and current row)),
 fi as (select bb.symbol, bb.ts, rsi.rsi, raw.regime, case when n = 20 and sd > 0 then (bb.close - (m - 2 * sd)) / (4 * sd) end as pctb, case when n = 20 and mv > 0 then bb.volume / mv end as rv, coalesce(y.pdi, 0) as pdi, coalesce(y.mdi, 0) as mdi, coalesce(ax.dx, 0) as adx, mk.rsi as market
   from bb join rsi using (symbol, ts) join raw using (symbol, ts) join s on s.symbol = bb.symbol and s.ts = bb.ts left join y on y.symbol = s.symbol and y.i = s.i left join ax on ax.symbol = s.symbol and ax.i = s.i left join rsi mk on mk.symbol = '{MARKET}' and mk.ts = bb.ts)"""
_GRID = " ".join(f"when price >= {a} then round_even(price / {s}::double, 0) * {s}::double" for a, s in ((50000, 100.0), (10000, 50.0), (1000, 5.0), (100, 1.0), (10, 0.5), (1, 0.1), (0.01, 0.001)))


def _snap(*steps: float) -> str:
    return "coalesce(list_filter([" + ", ".join(f"round_even(price / {s}::double, 0) * {s}::double" for s in steps) + "], lambda v: v > 0 and abs(v - price) / price < 0.003)[1], price)"


SQL = {
    "scored_zones": f"{BASE} select symbol, round(price, 4) as price, side, tier, round(score, 4) as score, touches, confirmed from z",
    "body_anchor_nearest": f"""{BASE}, sb as (select b.*, atr from b join sa using (symbol) where abs(close - open) > atr),
 e as (select symbol, i, n, atr, abs(close - open) as body, open as p, 1.0 as bonus, case when close > open then 'support' else 'resistance' end as side from sb union all select symbol, i, n, atr, abs(close - open), close, 0.5, case when close > open then 'resistance' else 'support' end from sb
   union all select symbol, i, n, atr, abs(close - open), high, 0, 'resistance' from sb union all select symbol, i, n, atr, abs(close - open), low, 0, 'support' from sb),
 c as (select z.symbol, z.price, z.side, p as anchor, bonus > 0 as be, abs(p - price) as distance, bonus + least(1, body / (atr * 2)) + (1 - (n - 1 - i) / n) * 0.5 - abs(p - price) / (atr * 0.6) * 0.3 as score from z join e on e.symbol = z.symbol and e.side = z.side and abs(p - price) <= atr * 0.6),
 r as (select *, row_number() over (partition by symbol, price, side order by be desc, case when be then -score else distance end, anchor) as place from c)
 select z.symbol, round(z.price, 4) as price, z.side, round(coalesce(anchor, z.price), 4) as anchor, case when be then 'Body' when anchor is not null then 'Wick' else 'Stat' end as anchor_type, round(abs(coalesce(anchor, z.price) - z.price) / z.price * 100, 3) as snap_pct
 from z left join r on r.symbol = z.symbol and r.price = z.price and r.side = z.side and place = 1""",
    "zones_merge": f"{BASE}, {_MERGED} select symbol, round(price, 4) as price, side, tier, round(score, 4) as score, touches, confirmed, merged from m",
    "sandwiched_minors": f"""{BASE}, {_MERGED} select symbol, round(price, 4) as price, side, tier from m join sa using (symbol) where not (tier = 'Minor' and exists (select 1 from m a where a.symbol = m.symbol and a.tier = 'Major' and a.price < m.price and m.price - a.price <= sa.atr)
   and exists (select 1 from m a where a.symbol = m.symbol and a.tier = 'Major' and a.price > m.price and a.price - m.price <= sa.atr))""",
    "cross_side_dedup": f"""{BASE} select symbol, round(price, 4) as price, side, round(score, 4) as score from z where not exists (select 1 from z o where o.symbol = z.symbol and o.side <> z.side
   and abs(o.price - z.price) / case when z.side = 'support' then z.price else o.price end < 0.02 and case when z.side = 'support' then o.score > z.score else o.score >= z.score end)""",
    "zone_rank_topk": f"""{BASE}, d as (select z.*, abs(price - last) / last as distance from z join lastp using (symbol) where case when side = 'support' then price < last else price >= last end),
 r as (select *, row_number() over (partition by symbol, side order by 0.8 * (1 - distance / 0.3) + 0.2 * least(1, score / 80) desc, price) as cut from d where distance <= 0.3),
 n as (select *, row_number() over (partition by symbol, side order by distance, price) as place from r where cut <= 9) select symbol, side, round(price, 4) as price, tier, touches, round(score, 4) as score, place, round(distance * 100, 1) as distance_pct from n where place <= 3""",
    "multi_window_levels": f"""with {H}, b0 as (select *, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from bars), win as (select * from (values ('short', 20), ('medium', 60), ('long', 180)) as t(name, days)),
 bw as (select symbol || '|' || name as symbol, ts, open, high, low, close, volume from b0, win where n >= days and i >= n - days), {N.split('), b as', 1)[1].join(['b as', '']).replace('from bars', 'from bw')}, {_TOUCH.replace('from bars', 'from bw')}
 select symbol, round(price, 4) as price, side, strength, touches, recency, anchor_bar from touch""",
    "round_levels": f"""with p as (select distinct l_extendedprice / l_quantity as price from lineitem)
 select price, case when price >= 1000 then round_even(price, 0) when price >= 10 then round_even(price * 10, 0) / 10 else round_even(price * 100, 0) / 100 end as tiered, case {_GRID} else price end as grid,
   case when price >= 1000 then {_snap(1000.0, 500.0, 100.0, 50.0)} when price >= 100 then {_snap(100.0, 50.0, 10.0, 5.0)} when price >= 10 then {_snap(10.0, 5.0, 0.5, 0.25)} else {_snap(0.5, 0.25, 0.1)} end as snapped from p""",
    "tpsl_cascade": f"{BASE}, {_TPSL} select * from tpsl",
    "rr_ranking": f"{BASE}, {_TPSL} select flavour, symbol, ratio, qualified, row_number() over (partition by flavour order by coalesce(ratio, -1) desc, symbol) as place from tpsl",
    "filter_chain": _FILTERS
    + """, c as (select symbol, ts, coalesce(market >= 50, false) as a, coalesce(rsi > 60, false) as b, rv is null or rv >= 1.5 as c, coalesce(pctb < 0.5, false) as d from fi)
 select symbol, ts, a and b and c and d as passed, concat_ws(',', case when not a then 'market_rsi_floor' end, case when not b then 'rsi_momentum' end, case when not c then 'relative_volume' end, case when not d then 'below_mean' end) as failed from c""",
    "filter_combos_256": _FILTERS
    + """, m9 as (select (market >= 50)::int * 1 as a, coalesce((rsi > 60)::int, 0) * 2 as b, (pdi > mdi)::int * 4 as c, (adx > 20)::int * 8 as d, coalesce((pctb < 0.8)::int, 0) * 16 as e, coalesce((rsi <= 80)::int, 0) * 32 as f, (rv is null or rv >= 1.5)::int * 64 as g, (regime <> 'D')::int * 128 as h from fi),
 k9 as (select coalesce(a, 0) + b + c + d + e + f + g + h as mask from m9), c as (select unnest(generate_series(0, 255)) as combination) select combination, count(*) as passing from c join k9 on mask & combination = combination group by 1""",
    "walk_forward_folds": f"""with t as (select distinct trade_id, {_DAY.format('entry_date')} as ts from trades), u as (select trade_id, ts from t where ts is not null), s as (select min(ts) as s from u),
 f as (select case when datesub('month', s, ts) >= 6 and (datesub('month', s, ts) - 6) // 6 < 4 then (datesub('month', s, ts) - 6) // 6 + 1 end as fold from u, s) select fold, count(*) as trades from f group by 1""",
}
