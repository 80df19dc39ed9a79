"""Queries over swings, profiles and levels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as I, levels as L
from tidemark.operators.lineage import stored
from tidemark.plans.series import H, hourly, rounded


def _atr(spark, d):
    return I.atr_last(hourly(spark, d))


def _points(spark, d):
    return L.swings(hourly(spark, d), _atr(spark, d))


def local_extrema(spark, d):
    return rounded(L.extrema(hourly(spark, d), 10))


def local_extrema_loose(spark, d):
    return rounded(L.extrema(hourly(spark, d), 5, strict=False))


def swings(spark, d):
    return rounded(_points(spark, d).select("symbol", "i", "kind", "price", "source"))


def swing_roles(spark, d):
    return rounded(L.swing_roles(_points(spark, d)).select("symbol", "i", "kind", "source", "price", "role", "structural"))


def break_counts(spark, d):
    return rounded(L.break_counts(_points(spark, d), hourly(spark, d), _atr(spark, d)))


def _structure_levels(points, rows, atr):
    return L.structure_levels(L.swing_roles(points), L.break_counts(points, rows, atr))


def structure_levels(spark, d):
    return rounded(_structure_levels(_points(spark, d), hourly(spark, d), _atr(spark, d)).drop("structural", "recency"), 5)


def volume_profile(spark, d):
    return rounded(L.volume_profile(hourly(spark, d)))


def value_area(spark, d):
    return rounded(L.value_area(L.volume_profile(hourly(spark, d))))


def high_volume_nodes(spark, d):
    return rounded(L.high_volume_nodes(L.volume_profile(hourly(spark, d), 200)))


def _highs(spark, d):
    return L.extrema(hourly(spark, d), 5).where("kind = 'high'").select("symbol", "price").distinct()


def gap_clusters(spark, d):
    return rounded(L.gap_clusters(_highs(spark, d), "x - y > 0.002 * y").groupBy("symbol", "cluster").agg(F.count("*").alias("members"), F.avg("price").alias("mean"), F.min("price").alias("lowest")))


def anchored_clusters(spark, d):
    return rounded(L.anchored_clusters(_highs(spark, d), "x - a <= 0.01 * a").groupBy("symbol", "anchor").agg(F.count("*").alias("members"), F.max("price").alias("highest")))


def touch_levels(spark, d):
    return rounded(L.touch_levels(hourly(spark, d)), 4)


def body_edge_levels(spark, d):
    rows = hourly(spark, d)
    return rounded(L.body_edge_levels(rows, I.atr_series(rows).select("symbol", "ts", "atr"), _atr(spark, d), 1.0), 4)


def flip_levels(spark, d):
    return rounded(L.flip_levels(hourly(spark, d), I.atr_last(hourly(spark, d)).withColumn("atr", F.col("atr") / 100)), 4)


def _volume_levels(rows):
    """High volume nodes by weight, the point of control at 0.9 and the bounds of the value area at 0.7."""
    profile = stored(L.volume_profile(rows, 200))
    area = L.value_area(profile).selectExpr("symbol", "stack(3, poc, 0.9D, low, 0.7D, high, 0.7D) as (price, strength)")
    found = L.high_volume_nodes(profile).select("symbol", "price", F.col("weight").alias("strength")).unionByName(area)
    return found.select("symbol", "price", "strength", F.lit("volume_profile").alias("method"), F.lit(0).cast("bigint").alias("touches"), F.lit(0.0).alias("recency"), F.lit("").alias("role"), F.lit(False).alias("body"))


def _all_levels(spark, d):
    return levels_of(hourly(spark, d))


def levels_of(bars):
    """Levels of all five methods of every symbol of ``bars``."""
    rows = stored(bars)  # bars, swings, profile and levels are used several times; one plan of all is too deep
    atr = I.atr_last(rows)
    none = F.lit("")
    touch = L.touch_levels(rows).select("symbol", "price", "strength", F.lit("touch_count").alias("method"), "touches", "recency", none.alias("role"), F.lit(False).alias("body"))
    edge = L.body_edge_levels(rows, I.atr_series(rows).select("symbol", "ts", "atr"), atr, 1.0)
    edge = edge.select("symbol", "price", "strength", F.lit("nison_body").alias("method"), "touches", "recency", none.alias("role"), F.lit(True).alias("body"))
    flip = L.flip_levels(rows, atr.withColumn("atr", F.col("atr") / 100))
    flip = flip.select("symbol", "price", "strength", F.lit("polarity_flip").alias("method"), "touches", "recency", F.lit("flip").alias("role"), F.lit(True).alias("body"))
    swing = stored(_structure_levels(stored(L.swings(rows, atr)), rows, atr))
    swing = swing.select("symbol", "price", "strength", F.lit("market_structure").alias("method"), "touches", "recency", F.col("structural").alias("role"), (F.col("source") == "body").alias("body"))
    return stored(touch.unionByName(edge).unionByName(flip).unionByName(swing).unionByName(_volume_levels(rows)))


def _prices(spark, d):
    return hourly(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("last"))


def ensemble_levels(spark, d):
    return rounded(L.merged_levels(_all_levels(spark, d), _prices(spark, d)).drop("snap", "wick"), 4)


def ensemble_snaps(spark, d):
    """The price each merged level was seen at, and what it hangs on."""
    return rounded(L.merged_levels(_all_levels(spark, d), _prices(spark, d)).select("symbol", "place", "side", "snap", "wick"), 4)


def fib_levels(spark, d):
    ratios = F.array(*(F.struct(F.lit(r).alias("ratio")) for r in (0.236, 0.382, 0.5, 0.618, 0.786)))
    ends = hourly(spark, d).groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    return rounded(ends.select("symbol", "lo", "hi", F.explode(ratios).alias("x")).select("symbol", "x.ratio", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("x.ratio")).alias("price")))


QUERIES = {
    f.__name__: f
    for f in (
        local_extrema, local_extrema_loose, swings, swing_roles, break_counts, structure_levels, volume_profile, value_area, high_volume_nodes, gap_clusters, anchored_clusters,
        touch_levels, body_edge_levels, flip_levels, ensemble_levels, ensemble_snaps, fib_levels,
    )
}

N = f"{H}, b as (select *, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n, greatest(open, close) as top, least(open, close) as bottom from bars)"
TR = "greatest(high - low, abs(high - lag(close) over (partition by symbol order by ts)), abs(low - lag(close) over (partition by symbol order by ts)))"
ATR = f"atr as (select symbol, avg(tr) as atr from (select symbol, {TR} as tr, row_number() over (partition by symbol order by ts desc) as r from bars) where r <= 14 group by 1)"


def _extrema(order: int, op: str, edge: str, name: str = "x") -> str:
    frames = f"window p as (partition by symbol order by i rows between {order} preceding and 1 preceding), q as (partition by symbol order by i rows between 1 following and {order} following)"
    return f"""{name}0 as (select *, max(high) over p as ph, max(high) over q as nh, min(low) over p as pl, min(low) over q as nl from b {frames}),
 {name} as (select symbol, i, 'high' as kind, high as price from {name}0 where coalesce(high {op} ph, {edge}) and coalesce(high {op} nh, {edge})
   union all select symbol, i, 'low', low from {name}0 where coalesce(pl {op} low, {edge}) and coalesce(nl {op} low, {edge}))"""


def _near(a: str, b: str) -> str:
    """Strict extremes of five bars by plain comparisons with the neighbours."""
    sides = lambda c, o: " and ".join(f"{c} {o} {f}({c}, {k}) over (partition by symbol order by i)" for f in ("lag", "lead") for k in (1, 2))
    return f"(select symbol, i, n, 'high' as kind, {a} as price from b qualify {sides(a, '>')}) union all (select symbol, i, n, 'low', {b} from b qualify {sides(b, '<')})"


SWINGS = f"""body as ({_near('top', 'bottom')}), wick as ({_near('high', 'low')}),
 points as (select *, 'body' as source from body union all select w.*, 'wick' from wick w where not exists (select 1 from body b join atr a on a.symbol = b.symbol where b.symbol = w.symbol and abs(w.price - b.price) < a.atr))"""
_PROFILE = """ends as (select symbol, min(low) as lo, max(high) as hi from bars group by 1), bins as (select symbol, unnest(generate_series(0, {bins} - 1)) as bin, lo, (hi - lo) / {bins} as step from ends),
 c as (select symbol, bin, lo + step * (bin + 0.5::double) as center from bins),
 hit as (select c.symbol, bin, volume * exp(-ln(2) * (n - 1 - i) / greatest(n // 3, 10)) / count(*) over (partition by b.symbol, b.i) as w from c join b on b.symbol = c.symbol and center between low and high),
 profile as (select c.symbol, c.bin, center, round(coalesce(sum(w), 0), 9) as volume from c left join hit using (symbol, bin) group by all)"""
_HIGHS = f"with {N}, {_extrema(5, '>', 'false')}, h as (select distinct symbol, price from x where kind = 'high')"
_TOUCH = f"""{_extrema(2, '>=', 'true', 'u')}, {_extrema(5, '>=', 'true', 'v')}, {_extrema(10, '>=', 'true', 'w')},
 cand as (select symbol, price from u union select symbol, price from v union select symbol, price from w),
 tg as (select *, sum(case when y is null or (price - y) / y >= 0.01 then 1 else 0 end) over (partition by symbol order by price) as g from (select *, lag(price) over (partition by symbol order by price) as y from cand)),
 tl as (select symbol, quantile_cont(price, 0.5) as level from tg group by symbol, g),
 tt as (select l.symbol, level, i, exp(-ln(2) * (n - 1 - i) / greatest(n // 3, 5)) as rec, case when abs(close - level) <= level * 0.005 then 1.0 when abs(open - level) <= level * 0.005 then 0.7
   when low <= level and low >= level - level * 0.01 then 0.3 when high >= level and high <= level + level * 0.01 then 0.3 end::double as w from tl l join b using (symbol)),
 ts_ as (select symbol, level, sum(w * rec) as score, count(*) as touches, avg(rec) as recency, arg_max(i, row(w * rec, -i)) as anchor_bar from tt where w is not null group by 1, 2 having sum(w * rec) >= 1.5),
 lastp as (select symbol, arg_max(close, ts) as last from bars group by 1),
 touch as (select symbol, level as price, case when level < last then 'support' else 'resistance' end as side, round(least(1, 0.6::double * score / greatest(0.01, max(score) over (partition by symbol)) + 0.4::double * recency), 4) as strength,
   touches, round(recency, 4) as recency, anchor_bar from ts_ join lastp using (symbol))"""
_SERIES = f"""tr0 as (select symbol, ts, {TR} as tr, row_number() over (partition by symbol order by ts) as k from bars),
 trs as (select symbol, ts, case when k <= 14 then avg(case when k <= 14 then tr end) over (partition by symbol) else avg(tr) over (partition by symbol order by ts rows between 13 preceding and current row) end as atr from tr0)"""
_EDGE = f"""{_SERIES}, big as (select b.symbol, i, n, open as price, abs(close - open) as body, case when close > open then 'support' else 'resistance' end as side from b join trs using (symbol, ts) where abs(close - open) > trs.atr * 1.0),
 ea as (select symbol, side, min(price) as a from big group by 1, 2 union all select ea.symbol, ea.side, (select min(price) from big g where g.symbol = ea.symbol and g.side = ea.side and g.price - ea.a > (select atr from atr where atr.symbol = ea.symbol)) as a
   from ea where a is not null),
 eg as (select g.*, (select max(a) from ea where ea.symbol = g.symbol and ea.side = g.side and a <= g.price) as anchor from big g),
 edge as (select symbol, side, round(arg_max(price, row(body, -price, -i)), 8) as price, count(*) as touches, round(avg(exp(-ln(2) * (n - 1 - i) / 40)), 4) as recency,
   round(0.4::double * least(1, count(*) / 5) + 0.3::double * least(1, avg(body) / (any_value(last) * 0.03::double)) + 0.3::double * avg(exp(-ln(2) * (n - 1 - i) / 40)), 4) as strength from eg join lastp using (symbol) group by symbol, side, anchor)"""
_FLIP = """fe as (select distinct symbol, round(p, 8) as price from (select *, avg(abs(close - open)) over (partition by symbol) as body, unnest([top, bottom]) as p from b) where abs(close - open) >= body * 0.5),
 ft as (select symbol, atr / 100 as atr from atr),
 fg as (select *, sum(case when y is null or price - y >= atr * 0.5 then 1 else 0 end) over (partition by symbol order by price) as g from (select *, lag(price) over (partition by symbol order by price) as y from fe join ft using (symbol))),
 fl as (select symbol, avg(price) as level, max(atr) * 0.5 as tol from fg group by symbol, g),
 f1 as (select l.symbol, level, i, n, case when bottom < level - tol / 2 and top > level + tol / 2 then null when abs(bottom - level) <= tol and close > level + tol / 2 then 'S' when abs(top - level) <= tol and close < level - tol / 2 then 'R' end as t from fl l join b using (symbol)),
 f2 as (select *, row_number() over (partition by symbol, level order by i) as k, count(*) over (partition by symbol, level) as m, max(i) over (partition by symbol, level) as last_i from f1 where t is not null),
 f3 as (select a.symbol, a.level, a.k, a.i, a.n, a.m, a.last_i, count(*) filter (c.k < a.k and c.t = 'S') as sb, count(*) filter (c.k < a.k and c.t = 'R') as rb, count(*) filter (c.k >= a.k and c.t = 'S') as sa, count(*) filter (c.k >= a.k and c.t = 'R') as ra
   from f2 a join f2 c on c.symbol = a.symbol and c.level = a.level where a.m >= 4 and a.k > 2 and a.k <= a.m - 1 group by all),
 f4 as (select *, 'S_to_R' as flip, sb as s, ra as r, 0 as o from f3 union all select *, 'R_to_S', sa, rb, 1 from f3),
 f5 as (select *, row_number() over (partition by symbol, level order by s + r desc, k, o) as place from f4 where s >= 2 and r >= 2),
 flips as (select symbol, round(level, 8) as price, flip, case when flip = 'S_to_R' and level < last * 0.97 then 'support' when flip = 'R_to_S' and level > last * 1.03 then 'resistance' when flip = 'S_to_R' then 'resistance' else 'support' end as side,
   s + r as touches, i as flip_bar, round(1 - (n - 1 - last_i) / n, 4) as recency, round(least(1, 0.4::double * least(1, (s + r) / 10) + 0.3::double * least(1, least(s, r) / 3) + 0.3::double * (1 - (n - 1 - last_i) / n)), 4) as strength from f5 join lastp using (symbol) where place = 1)"""

SQL = {
    "local_extrema": f"with {N}, {_extrema(10, '>', 'false')} select symbol, i, kind, round(price, 6) as price from x",
    "local_extrema_loose": f"with {N}, {_extrema(5, '>=', 'true')} select symbol, i, kind, round(price, 6) as price from x",
    "swings": f"with {N}, {ATR}, {SWINGS} select symbol, i, kind, round(price, 6) as price, source from points",
    "swing_roles": f"""with {N}, {ATR}, {SWINGS}, q as (select *, lag(price) over (partition by symbol, kind order by i, source) as before from points),
 r as (select *, case when kind = 'high' then case when before is null or price > before then 'HH' else 'LH' end else case when before is null or price > before then 'HL' else 'LL' end end as role from q),
 o as (select *, row_number() over (partition by symbol order by i, kind, source) as k, role in ('HH', 'HL') as up from r)
 select a.symbol, a.i, a.kind, a.source, round(a.price, 6) as price, a.role, case when exists (select 1 from o b where b.symbol = a.symbol and b.k < a.k and b.role in ('HH', 'LL')) and (select c.up from o c where c.symbol = a.symbol and c.k = a.k - 1) <> a.up then 'CHOCH' else 'BOS' end as structural from o a""",
    "break_counts": f"""with {N}, {ATR}, {SWINGS}, mean as (select symbol, avg(volume) as mean from bars group by 1), s as (select *, i = max(i) over (partition by symbol, kind) as newest from points),
 h as (select s.symbol, s.i, s.kind, s.source, b.i as pos, least(b.volume / mean, 2) as w, case when kind = 'high' then b.close > price + 0.25 * atr else b.close < price - 0.25 * atr end as broken from s join atr using (symbol) join mean using (symbol) join b on b.symbol = s.symbol and b.i > s.i where not newest),
 g as (select *, sum(case when broken then 0 else 1 end) over (partition by symbol, i, kind, source order by pos) as run from h), r as (select symbol, i, kind, source, run, count(*) filter (broken) as length, coalesce(sum(w) filter (broken), 0) as w from g group by all),
 t as (select symbol, i, kind, source, max(length) as longest, sum(w) as breaks from r group by all)
 select symbol, i, kind, source, round(price, 6) as price, round(coalesce(breaks, 0), 6) as breaks, coalesce(longest, 0) >= 2 as killed from s left join t using (symbol, i, kind, source)""",
    "volume_profile": f"with {N}, {_PROFILE.format(bins=50)} select symbol, bin, round(center, 6) as center, round(volume, 6) as volume from profile",
    "value_area": f"""with recursive {N}, {_PROFILE.format(bins=50)}, tot as (select symbol, sum(volume) as total, arg_min(bin, row(-volume, bin)) as poc from profile group by 1),
 va as (select symbol, poc as lo, poc as hi, volume as got, total from tot join profile using (symbol) where bin = poc
   union all select va.symbol, case when lo > 0 and coalesce(l.volume, 0) >= coalesce(r.volume, 0) then lo - 1 else lo end, case when lo > 0 and coalesce(l.volume, 0) >= coalesce(r.volume, 0) then hi else hi + 1 end,
     got + case when lo > 0 and coalesce(l.volume, 0) >= coalesce(r.volume, 0) then l.volume else r.volume end, total
   from va left join profile l on l.symbol = va.symbol and l.bin = lo - 1 left join profile r on r.symbol = va.symbol and r.bin = hi + 1 where got < total * 0.7 and (lo > 0 or hi < 49)),
 f as (select *, row_number() over (partition by symbol order by got desc, hi - lo desc) as k from va)
 select symbol, round(p.center, 6) as poc, round(a.center, 6) as low, round(z.center, 6) as high, round(got / f.total, 6) as share from f join tot using (symbol) join profile p on p.symbol = f.symbol and p.bin = poc join profile a on a.symbol = f.symbol and a.bin = lo join profile z on z.symbol = f.symbol and z.bin = hi where k = 1""",
    "high_volume_nodes": f"""with {N}, {_PROFILE.format(bins=200)}, o as (select symbol, unnest(generate_series(0, 199)) as bin from ends), k as (select symbol, bin, unnest(generate_series(bin - 5, bin + 4)) as pos from o),
 m as (select symbol, bin, case when pos < 0 then -1 - pos when pos > 199 then 399 - pos else pos end as pos from k), s as (select m.symbol, m.bin, round(avg(volume), 6) as smooth from m join profile p on p.symbol = m.symbol and p.bin = m.pos group by all),
 t as (select symbol, quantile_cont(volume, 0.75) as least from profile group by 1),
 w as (select *, max(smooth) over (partition by symbol) as top, max(smooth) over (partition by symbol order by bin rows between 3 preceding and 1 preceding) as l, max(smooth) over (partition by symbol order by bin rows between 1 following and 3 following) as r from s)
 select w.symbol, w.bin, round(center, 6) as price, round(smooth / top, 6) as weight from w join t using (symbol) join profile using (symbol, bin) where smooth > l and smooth > r and smooth >= least""",
    "gap_clusters": f"""{_HIGHS}, g as (select *, sum(case when y is null or price - y > 0.002 * y then 1 else 0 end) over (partition by symbol order by price) as cluster from (select *, lag(price) over (partition by symbol order by price) as y from h))
 select symbol, cluster::bigint as cluster, count(*) as members, round(avg(price), 6) as mean, round(min(price), 6) as lowest from g group by 1, 2""",
    "anchored_clusters": f"""{_HIGHS.replace('with ', 'with recursive ', 1)}, a as (select symbol, min(price) as a from h group by 1 union all select a.symbol, (select min(price) from h where h.symbol = a.symbol and price - a.a > 0.01 * a.a) from a where a.a is not null),
 g as (select *, (select max(a.a) from a where a.symbol = h.symbol and a.a <= price) as anchor from h) select symbol, round(anchor, 6) as anchor, count(*) as members, round(max(price), 6) as highest from g group by symbol, anchor""",
    "touch_levels": f"with {N}, {_TOUCH} select symbol, round(price, 4) as price, side, strength, touches, recency, anchor_bar from touch",
    "body_edge_levels": f"with recursive {N}, {ATR}, lastp as (select symbol, arg_max(close, ts) as last from bars group by 1), {_EDGE} select symbol, side, round(price, 4) as price, touches, recency, strength from edge",
    "flip_levels": f"with {N}, {ATR}, lastp as (select symbol, arg_max(close, ts) as last from bars group by 1), {_FLIP} select symbol, round(price, 4) as price, flip, side, touches, flip_bar, recency, strength from flips",
    "fib_levels": f"with {H}, e as (select symbol, min(low) as lo, max(high) as hi from bars group by 1), r as (select unnest([0.236, 0.382, 0.5, 0.618, 0.786])::double as ratio) select symbol, ratio, round(lo + (hi - lo) * ratio, 6) as price from e, r",
}
_SWUP = f"""ro as ({SQL['swing_roles']}), br as (select symbol, i, kind, source, breaks, killed from ({SQL['break_counts']})), nn as (select symbol, count(*) as n from (with {H} select * from bars) group by 1),
 js as (select ro.*, n, breaks, killed, exp(-(n - 1 - i) / 30.0::double) as recency, case when source = 'wick' then 0.85::double else 1 end as w from ro join br using (symbol, i, kind, source) join nn using (symbol)),
 us as (select *, false as flipped, case when structural = 'CHOCH' then 0.85::double when role in ('HL', 'LH') then 0.65 else 0.45 end as base, case when breaks <= 0 then 1::double else greatest(0.1::double, 1 - 0.3::double * breaks) end as kept, 1 + floor(breaks)::bigint as touches from js where not killed and breaks < 3
   union all select *, true, 0.3, 1, 1 from js where breaks >= 2),
 ms as (select *, round((base * w * 0.7::double + recency * 0.3::double) * kept + 1e-9, 4) as strength from us)"""
SQL["structure_levels"] = f"""with {_SWUP} select symbol, i as bar, round(price, 5) as price, source, case when (kind = 'low') <> flipped then 'support' else 'resistance' end as side, flipped,
 case when flipped then 'flip' when structural = 'CHOCH' then 'CHOCH' else role end as role, round(strength, 5) as strength, touches from ms"""


_AREA = SQL["value_area"].replace("generate_series(0, 50 - 1)", "generate_series(0, 200 - 1)").replace("(hi - lo) / 50", "(hi - lo) / 200").replace("hi < 49", "hi < 199").replace("round(p.center, 6)", "p.center").replace("round(a.center, 6)", "a.center").replace("round(z.center, 6)", "z.center")
_PV = f"""hv as ({SQL['high_volume_nodes'].replace("round(center, 6) as price, round(smooth / top, 6)", "center as price, smooth / top")}), va as ({_AREA}),
 pv as (select symbol, price, weight as strength from hv union all select symbol, poc, 0.9 from va union all select symbol, low, 0.7 from va union all select symbol, high, 0.7 from va)"""
SQL["ensemble_levels"] = f"""with recursive {_SWUP}, {_PV}, {N}, {ATR}, {_TOUCH}, {_EDGE}, {_FLIP}, u9 as (select symbol, price, strength, 'touch_count' as method, touches::bigint as touches, recency, '' as role, 1.0::double as bonus, 0.25::double as weight from touch
   union all select symbol, price, strength, 'nison_body', touches, recency, '', 1.5, 0.15 from edge union all select symbol, price, strength, 'polarity_flip', touches, recency, 'flip', 1.5, 0.10 from flips
   union all select symbol, price, strength, 'market_structure', touches, round(recency, 4), case when flipped then case when kind = 'high' then 'flipped_resistance' else 'flipped_support' end else role || '_' || structural end, case when source = 'body' then 1.5 else 1 end, 0.40 from ms
   union all select symbol, price, strength, 'volume_profile', 0, 0, '', 1, 0.10 from pv),
 m as (select symbol, min(price) as a from u9 group by 1 union all select m.symbol, (select min(price) from u9 where u9.symbol = m.symbol and (price - m.a) / m.a > 0.005) from m where m.a is not null),
 g as (select *, (select max(m.a) from m where m.symbol = u9.symbol and m.a <= price) as anchor from u9),
 j9 as (select symbol, anchor, sum(price * strength * bonus) / sum(strength * bonus) as raw, string_agg(distinct method, '+' order by method) as method, sum(touches) as touches, max(recency) as recency,
   arg_max(bonus, row(strength, bonus > 1, -price)) as bb, min(price) as lowest, max(price) as highest, arg_min(role, row(case when contains(role, 'CHOCH') then 0 when contains(role, 'flip') then 1 when contains(role, 'BOS') then 2 else 9 end, price, method, role)) as role,
   round(least(1, least(1, sum(strength * weight) + least(0.3::double, (count(distinct method) - 1) * 0.1::double)) + case when bool_or(method = 'polarity_flip') then 0.1::double else 0 end) + 1e-9, 4) as strength from g group by symbol, anchor),
 k9 as (select *, row_number() over (partition by symbol order by strength desc, raw) as place from j9 where strength >= 0.1)
 select symbol, round(raw, 4) as price, case when raw < last then 'support' else 'resistance' end as side, strength, method, touches::bigint as touches, recency, role, place from k9 join lastp using (symbol) where place <= 20"""
SQL["ensemble_snaps"] = SQL["ensemble_levels"].split(" select symbol, round(raw, 4) as price, case when raw < last")[0] + """ select symbol, place, case when raw < last then 'support' else 'resistance' end as side,
  round(case when raw < last then lowest else highest end, 4) as snap, bb = 1 as wick from k9 join lastp using (symbol) where place <= 20"""
