"""Queries over candle series and their SQL: building, resampling, indicators, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import bars as B, indicators as I, states as S
from tidemark.sources.tables import table

AS_OF = "1998-06-17"  # shipments go on after this day, so that bars in progress exist


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.event_candles(table(spark, d, "events"))


def shipped(spark: SparkSession, d: str) -> DataFrame:
    return B.shipment_candles(table(spark, d, "lineitem"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily candles of each feed as a series of its own (``symbol#feed``): of bars with one time the last loaded, without
    bars whose prices contradict each other; a missing volume counts as 1."""
    rows = table(spark, d, "daily_candles").where("feed_id is not null and ts is not null")
    last = rows.groupBy("feed_id", "ts").agg(F.max_by(F.struct("symbol", *B.OHLCV), F.struct("loaded_at", "close", "volume")).alias("x"))
    bars = last.select(F.concat_ws("#", "x.symbol", F.col("feed_id").cast("string")).alias("symbol"), "ts", *(F.col(f"x.{c}") for c in B.OHLCV[:4]), F.coalesce("x.volume", F.lit(1.0)).alias("volume"))
    return bars.where("least(open, high, low, close) > 0 and high >= greatest(open, close) and low <= least(open, close)")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def bars_hourly(spark, d):
    return rounded(hourly(spark, d))


def bars_daily(spark, d):
    return rounded(B.resample(hourly(spark, d), "day"))


def bars_weekly(spark, d):
    return rounded(B.resample(shipped(spark, d), "week", AS_OF))


def bars_monthly(spark, d):
    return rounded(B.resample(shipped(spark, d), "month", AS_OF))


def closed_bars(spark, d):
    return B.closed_bars(shipped(spark, d), AS_OF)


def upsert_keep_last(spark, d):
    """Stored hourly bars with fresh ones of every third hour, whose volume is corrected by one."""
    rows = hourly(spark, d)
    third = F.hour("ts") % 3 == 0
    fresh = rows.where(third).withColumn("volume", F.col("volume") + 1)
    return rounded(B.upsert_keep_last(rows, fresh))


def cache_status(spark, d):
    status = B.freshness(shipped(spark, d), table(spark, d, "tokens").select("symbol").unionByName(shipped(spark, d).select("symbol")), "1999-01-05")
    return status.select("symbol", F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "missing", "action")


def source_fallback(spark, d):
    rows = table(spark, d, "daily_candles").select("symbol", "source", "ts", "open", "high", "low", "close", "volume").distinct()
    return B.first_good_source(rows, ["northbook", "kestrel", "bluepier", "dexmill", "poolwatch", "snapgate"])


def kline_payloads(spark, d):
    """Hourly bars written as one JSON payload a symbol and read back."""
    rows = hourly(spark, d).withColumn("k", F.array(*(F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume"))))
    entry = F.concat(F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")), F.col("k"))
    packed = rows.groupBy("symbol").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("body"))
    return rounded(B.klines(packed).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def true_range_atr(spark, d):
    return rounded(I.atr_last(hourly(spark, d)))


def atr_series(spark, d):
    return rounded(I.atr_series(hourly(spark, d)).select("symbol", "ts", "atr"))


def sma_multi(spark, d):
    return rounded(hourly(spark, d).select("symbol", "ts", *(I.sma(p).alias(f"sma_{p}") for p in (20, 50, 100, 200))))


def rsi_simple(spark, d):
    return rounded(I.rsi_simple(hourly(spark, d)).select("symbol", "ts", "rsi"))


def rvol(spark, d):
    return rounded(hourly(spark, d).select("symbol", "ts", I.relative_volume().alias("rvol")))


def bollinger_pctb(spark, d):
    return rounded(hourly(spark, d).select("symbol", "ts", I.percent_b().alias("pctb")))


def risk_features(spark, d):
    return rounded(I.risk_features(hourly(spark, d)).select("symbol", "ts", "f_momentum", "f_vol_regime", "f_drawdown", "f_dir_volume"))


def ema_trend(spark, d):
    rows = I.recurrent_indicators(hourly(spark, d), ["ema_12", "ema_26"])
    seen = F.row_number().over(I.by())
    trend = F.when((seen >= 31) & (F.col("ema_26") != 0), I.clipped((F.col("ema_12") - F.col("ema_26")) / F.col("ema_26") / 0.05)).otherwise(F.lit(0.0))
    return rounded(rows.select("symbol", "ts", "ema_12", "ema_26", trend.alias("f_trend")), 5)


def _variant(name: str):
    def query(spark, d):
        columns = [c for c in I.RECURRENT if c.startswith(f"{name}_")]
        return rounded(I.recurrent_indicators(hourly(spark, d), columns).drop("close"), 5)

    query.__name__ = f"adx_{name}"
    return query


adx_core, adx_regime, adx_roro = (_variant(n) for n in ("core", "regime", "roro"))


def rsi_wilder(spark, d):
    return rounded(I.recurrent_indicators(hourly(spark, d), ["rsi_wilder"]).drop("close"), 5)


def roro_composite(spark, d):
    return rounded(S.risk_composite(hourly(spark, d)), 4)


def regime_udt(spark, d):
    return S.trend_regime(hourly(spark, d), 40, 20).select("symbol", "ts", "regime")


def regime_debounced(spark, d):
    raw = S.trend_regime(hourly(spark, d), 40, 20)
    return S.debounced(raw, 3).select("symbol", "ts", "regime", "confirmed")


def rsi_hysteresis(spark, d):
    return S.hysteresis(I.rsi_simple(hourly(spark, d)), "rsi", 60.0, 50.0).select("symbol", "ts", "on")


def mtf_regimes(spark, d):
    return S.three_timeframes(hourly(spark, d)).select("symbol", "ts", "long_term", "mid_term", "short_term", "gate_key")


def regime_classify(spark, d):
    return S.classified(hourly(spark, d)).select("symbol", "ts", "regime")


def regime_scan_pivot(spark, d):
    """Weekly snapshots of the regime, counted for each symbol."""
    rows = S.classified(hourly(spark, d)).where("regime is not null")
    last = rows.groupBy("symbol", F.date_trunc("week", "ts").alias("week")).agg(F.max_by("regime", "ts").alias("regime"), F.max("ts").alias("ts"))
    return last.groupBy("symbol").pivot("regime", ["BULL", "BEAR", "NEUTRAL", "TRANSITION", "RANGE"]).agg(F.count("ts")).fillna(0)


def rank_by_rsi_topn(spark, d):
    rows = I.rsi_simple(hourly(spark, d)).where("rsi is not null")
    r = F.row_number().over(Window.partitionBy("ts").orderBy(F.col("rsi").desc(), "symbol"))
    return rounded(rows.withColumn("place", r).where("place <= 2").select("ts", "symbol", "rsi", F.col("place").cast("bigint").alias("place")))


def weekly_atr(spark, d):
    rows = B.resample(shipped(spark, d), "week", AS_OF)
    before = F.lag("close").over(I.by())
    tr = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    out = rows.withColumn("tr", tr)
    return rounded(out.select("symbol", "ts", F.when(F.count("tr").over(I.last(10)) == 10, F.avg("tr").over(I.last(10))).alias("atr")), 5)


QUERIES = {
    f.__name__: f
    for f in (
        bars_hourly, bars_daily, bars_weekly, bars_monthly, closed_bars, upsert_keep_last, cache_status, source_fallback, kline_payloads, true_range_atr, atr_series,
        sma_multi, rsi_simple, rvol, bollinger_pctb, risk_features, ema_trend, adx_core, adx_regime, adx_roro, rsi_wilder, roro_composite, regime_udt, regime_debounced,
        rsi_hysteresis, mtf_regimes, regime_classify, regime_scan_pivot, rank_by_rsi_topn, weekly_atr,
    )
}

H = """bars as (select event_type as symbol, date_trunc('hour', ts) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low,
  arg_max(value, ts) as close, count(*)::double as volume from events group by 1, 2)"""
D = """bars as (select l_returnflag as symbol, date_trunc('day', l_shipdate)::timestamp as ts, arg_min(p, o) as open, max(p) as high, min(p) as low, arg_max(p, o) as close, sum(l_quantity) as volume
  from (select *, l_extendedprice / l_quantity as p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus) as o from lineitem) group by 1, 2)"""
SIX = "round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume"
_RE = """select symbol, date_trunc('{u}', ts)::timestamp as ts, round(arg_min(open, ts), 6) as open, round(max(high), 6) as high, round(min(low), 6) as low,
  round(arg_max(close, ts), 6) as close, round(sum(volume), 6) as volume from bars group by 1, date_trunc('{u}', ts)"""
_W = "window w as (partition by symbol order by ts)"
# one row a bar with everything the recurrences take
_STEPS = f"""with recursive {H}, p as (select *, row_number() over w - 1 as i, lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl from bars {_W}),
 s as (select symbol, ts, i, close, case when pc is null then 0 else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr,
   case when high - ph > pl - low and high - ph > 0 then high - ph else 0 end as dp, case when pl - low > high - ph and pl - low > 0 then pl - low else 0 end as dm,
   greatest(coalesce(close - pc, 0), 0) as g, greatest(coalesce(pc - close, 0), 0) as l from p)"""


def _chain(name: str, source: str, columns: tuple[str, ...], p: int, first: int, seed: int) -> str:
    """Recursive CTE of Wilder sums: the mean of bars first..seed at bar seed, then one step a bar."""
    means = ", ".join(f"avg({c}) as {c}" for c in columns)
    steps = ", ".join(f"(r.{c} * {p - 1} + s.{c}) / {p}" for c in columns)
    return f"""{name} as (select symbol, {seed}::bigint as i, {means} from {source} where i between {first} and {seed} group by symbol having max(i) = {seed}
  union all select s.symbol, s.i, {steps} from {name} r join {source} s on s.symbol = r.symbol and s.i = r.i + 1)"""


_DI = "case when tr > 0 then 100 * dp / tr else 0 end as pdi, case when tr > 0 then 100 * dm / tr else 0 end as mdi"
_DX = "case when pdi + mdi > 0 then 100 * abs(pdi - mdi) / (pdi + mdi) else 0 end as dx"
_RSI100 = "100 - 100 / (1 + case when l > 0 then g / l else 100 end)"


_DIRECTIONAL = f"""{_STEPS}, {_chain('k', 's', ('tr', 'dp', 'dm'), 14, 1, 14)}, q as (select symbol, i, {_DI} from k), y as (select *, {_DX} from q),
   x as (select s.symbol, s.i, coalesce(dx, 0) as dx from s left join y using (symbol, i)), {_chain('a', 'x', ('dx',), 14, 1, 14)}, {_chain('g', 's', ('g', 'l'), 8, 1, 8)},
   v as (select s.symbol, s.ts, case when s.i < 14 then 0 else pdi end as pdi, case when s.i < 14 then 0 else mdi end as mdi, a.dx as adx, case when s.i > 8 then {_RSI100.replace("l > 0", "g.l > 0").replace("then g / l", "then g.g / g.l")} end as rsi
     from s left join q using (symbol, i) left join a using (symbol, i) left join g using (symbol, i)) """
_LABEL = """case when adx >= 28.92 and abs(pdi - mdi) >= 5.47 and pdi > mdi and rsi > 56.4 then 'BULL' when adx >= 28.92 and abs(pdi - mdi) >= 5.47 and pdi < mdi and rsi < 48.08 then 'BEAR'
   when adx >= 28.92 then 'NEUTRAL' when adx > 19.02 then 'TRANSITION' when adx <= 19.02 then 'RANGE' end"""


_REGIME = f"""m as (select *, case when count(*) over a = 40 then avg(close) over a end as m from bars window a as (partition by symbol order by ts rows between 39 preceding and current row)),
 x as (select *, coalesce(close > m, false) as above, coalesce(m > lag(m, 20) over w, false) as rising from m {_W}),
 raw as (select symbol, ts, case when above and rising then 'U' when not above and not rising then 'D' else 'T' end as regime from x)"""
_RSI = """d as (select *, close - lag(close) over (partition by symbol order by ts) as d from bars), e as (select *, avg(greatest(d, 0)) over w as u, avg(greatest(-d, 0)) over w as l, row_number() over (partition by symbol order by ts) as r
  from d window w as (partition by symbol order by ts rows between 9 preceding and current row)), rsi as (select symbol, ts, close, volume, case when r > 10 then case when l = 0 then 100 else 100 - 100 / (1 + u / l) end end as rsi from e)"""

SQL = {
    "bars_hourly": f"with {H} select symbol, ts, {SIX} from bars",
    "bars_daily": f"with {H} " + _RE.format(u="day"),
    "bars_weekly": f"with {D} " + _RE.format(u="week") + f" having date_trunc('week', ts) + interval 7 day <= timestamp '{AS_OF}'",
    "bars_monthly": f"with {D} " + _RE.format(u="month") + f" having date_trunc('month', ts) + interval 1 month <= timestamp '{AS_OF}'",
    "closed_bars": f"with {D} select symbol, ts, open, high, low, close, volume from bars where ts < timestamp '{AS_OF}'",
    "upsert_keep_last": f"with {H} select symbol, ts, {SIX.replace('round(volume, 6)', 'case when hour(ts) % 3 = 0 then volume + 1 else volume end')} from bars",
    "cache_status": f"""with {D}, s as (select symbol from tokens union select symbol from bars), l as (select symbol, max(ts)::date as last_day from bars group by 1),
 m as (select symbol, last_day, coalesce(date '1999-01-05' - last_day, 999) as missing from s left join l using (symbol))
 select symbol, strftime(last_day, '%Y-%m-%d') as last_day, missing, case when missing <= 1 then 'skip' when missing <= 30 then 'append' else 'full' end as action from m""",
    "source_fallback": """with r as (select distinct symbol, source, ts, open, high, low, close, volume from daily_candles), c as (select symbol, source, row_number() over (partition by symbol
   order by list_position(['northbook', 'kestrel', 'bluepier', 'dexmill', 'poolwatch', 'snapgate'], source)) as p from r group by 1, 2 having count(*) >= 30)
 select r.* from r join c using (symbol, source) where p = 1""",
    "kline_payloads": f"with {H} select symbol, ts, {SIX} from bars",
    "true_range_atr": f"""with {H}, t as (select symbol, ts, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from bars {_W}),
 r as (select *, row_number() over (partition by symbol order by ts desc) as r from t) select symbol, round(avg(tr), 6) as atr from r where r <= 14 group by 1""",
    "atr_series": f"""with {H}, t as (select symbol, ts, row_number() over w as i, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from bars {_W})
 select symbol, ts, round(case when i <= 14 then avg(case when i <= 14 then tr end) over (partition by symbol) else avg(tr) over (partition by symbol order by ts rows between 13 preceding and current row) end, 6) as atr from t""",
    "sma_multi": f"with {H} select symbol, ts, "
    + ", ".join(f"round(case when count(*) over w{p} = {p} then avg(close) over w{p} end, 6) as sma_{p}" for p in (20, 50, 100, 200))
    + " from bars window "
    + ", ".join(f"w{p} as (partition by symbol order by ts rows between {p - 1} preceding and current row)" for p in (20, 50, 100, 200)),
    "rsi_simple": f"with {H}, {_RSI} select symbol, ts, round(rsi, 6) as rsi from rsi",
    "rvol": f"""with {H}, a as (select symbol, ts, volume, case when count(*) over w = 20 then avg(volume) over w end as m from bars window w as (partition by symbol order by ts rows between 19 preceding and current row))
 select symbol, ts, round(coalesce(case when m > 0 then volume / m end, 1), 6) as rvol from a""",
    "bollinger_pctb": f"""with {H}, a as (select symbol, ts, close, count(*) over w as n, avg(close) over w as m, stddev_pop(close) over w as s from bars window w as (partition by symbol order by ts rows between 19 preceding and current row))
 select symbol, ts, round(case when n = 20 and s > 0 then (close - (m - 2 * s)) / (4 * s) end, 6) as pctb from a""",
    "risk_features": f"""with {H}, r as (select *, close / lag(close) over w - 1 as r, close - lag(close) over w as d, close / lag(close, 20) over w - 1 as r20, row_number() over w as i from bars {_W}),
 a as (select *, stddev_samp(r) over (partition by symbol order by ts rows between 19 preceding and current row) as v20, stddev_samp(r) over (partition by symbol order by ts rows between 4 preceding and current row) as v5,
   max(close) over (partition by symbol order by ts rows between 20 preceding and current row) as top,
   sum(case when d > 0 then volume else 0 end) over x as u, sum(case when d < 0 then volume else 0 end) over x as l from r window x as (partition by symbol order by ts rows between 18 preceding and current row))
 select symbol, ts, round(case when i >= 22 and v20 > 0 then greatest(-1, least(1, r20 / v20 / 2)) else 0 end, 6) as f_momentum, round(case when i >= 22 and v20 > 0 then greatest(-1, least(1, (v20 - v5) / v20)) else 0 end, 6) as f_vol_regime,
   round(case when i >= 21 and top <> 0 then greatest(-1, least(1, 1 + (close - top) / top / 0.2::double * 2)) else 0 end, 6) as f_drawdown, round(case when i >= 21 and u + l > 0 then greatest(-1, least(1, (u / (u + l) - 0.5) * 4)) else 0 end, 6) as f_dir_volume from a""",
    "ema_trend": f"""{_STEPS}, e as (select symbol, i, close as f, close as s from s where i = 0 union all
   select s.symbol, s.i, e.f * (1 - 2.0::double / 13) + s.close * (2.0::double / 13), e.s * (1 - 2.0::double / 27) + s.close * (2.0::double / 27) from e join s on s.symbol = e.symbol and s.i = e.i + 1)
 select symbol, ts, round(f, 5) as ema_12, round(e.s, 5) as ema_26, round(case when i >= 30 and e.s <> 0 then greatest(-1, least(1, (f - e.s) / e.s / 0.05::double)) else 0 end, 5) as f_trend from e join s using (symbol, i)""",
    "adx_core": f"""{_STEPS}, {_chain('k', 's', ('tr', 'dp', 'dm'), 14, 1, 14)}, q as (select symbol, i, {_DI} from k), x as (select *, {_DX} from q), {_chain('a', 'x', ('dx',), 14, 15, 28)}
 select s.symbol, s.ts, round(coalesce(pdi, 0), 5) as core_di_plus, round(coalesce(mdi, 0), 5) as core_di_minus, round(coalesce(a.dx, 0), 5) as core_adx from s left join x using (symbol, i) left join a using (symbol, i)""",
    "adx_regime": _DIRECTIONAL + "select symbol, ts, round(pdi, 5) as regime_di_plus, round(mdi, 5) as regime_di_minus, round(adx, 5) as regime_adx, round(rsi, 5) as regime_rsi from v",
    "regime_classify": _DIRECTIONAL + f"select symbol, ts, {_LABEL} as regime from v",
    "regime_scan_pivot": _DIRECTIONAL
    + f""", c as (select symbol, ts, {_LABEL} as regime from v), w as (select symbol, date_trunc('week', ts) as week, arg_max(regime, ts) as regime from c where regime is not null group by 1, 2)
 select symbol, """
    + ", ".join(f"count(*) filter (regime = '{k}') as \"{k}\"" for k in ("BULL", "BEAR", "NEUTRAL", "TRANSITION", "RANGE"))
    + " from w group by 1",
    "mtf_regimes": f"with {H}, "
    + ", ".join(
        f"""{k}0 as (select *, case when count(*) over a = {p} then avg(close) over a end as m from bars window a as (partition by symbol order by ts rows between {p - 1} preceding and current row)),
 {k}1 as (select *, coalesce(close > m, false) as a, coalesce(m > lag(m, {g}) over w, false) as r from {k}0 {_W}), {k} as (select symbol, ts, case when a and r then 'U' when not a and not r then 'D' else 'T' end as s from {k}1)"""
        for k, p, g in (("lt", 100, 20), ("mt", 50, 10), ("st", 20, 5))
    )
    + " select symbol, ts, lt.s as long_term, mt.s as mid_term, st.s as short_term, concat_ws('/', lt.s, mt.s, st.s) as gate_key from lt join mt using (symbol, ts) join st using (symbol, ts)",
    "adx_roro": f"""{_STEPS}, {_chain('k', 's', ('tr', 'dp', 'dm'), 14, 0, 13)}, q as (select symbol, i, {_DI} from k), y as (select *, {_DX} from q),
   x as (select s.symbol, s.i, coalesce(dx, 0) as dx from s left join y using (symbol, i)), {_chain('a', 'x', ('dx',), 14, 0, 13)}, {_chain('g', 's', ('g', 'l'), 8, 0, 7)}
 select s.symbol, s.ts, round(coalesce(pdi, 0), 5) as roro_di_plus, round(coalesce(mdi, 0), 5) as roro_di_minus, round(a.dx, 5) as roro_adx,
   round(case when g.l > 0 then 100 - 100 / (1 + g.g / g.l) when g.g > 0 then 100 when g.g = 0 then 50 end, 5) as roro_rsi from s left join q using (symbol, i) left join a using (symbol, i) left join g using (symbol, i)""",
    "rsi_wilder": f"""{_STEPS}, {_chain('g', 's', ('g', 'l'), 10, 0, 9)} select s.symbol, s.ts, round(case when g.l > 0 then 100 - 100 / (1 + g.g / g.l) when g.g > 0 then 100 end, 5) as rsi_wilder from s left join g using (symbol, i)""",
    "regime_udt": f"with {H}, {_REGIME} select symbol, ts, regime from raw",
    "regime_debounced": f"""with {H}, {_REGIME}, c as (select *, case when regime <> lag(regime) over w then 1 else 0 end as c from raw {_W}), g as (select *, sum(c) over w as g from c {_W}),
 k as (select *, row_number() over (partition by symbol, g order by ts) as k from g) select symbol, ts, regime, coalesce(last_value(case when k >= 3 then regime end ignore nulls) over (partition by symbol order by ts rows unbounded preceding), 'T') as confirmed from k""",
    "rsi_hysteresis": f"""with {H}, {_RSI} select symbol, ts, coalesce(last_value(case when rsi > 60 then true when rsi < 50 then false end ignore nulls) over (partition by symbol order by ts rows unbounded preceding), false) as "on" from rsi""",
    "rank_by_rsi_topn": f"""with {H}, {_RSI}, r as (select ts, symbol, rsi, row_number() over (partition by ts order by rsi desc, symbol) as place from rsi where rsi is not null) select ts, symbol, round(rsi, 6) as rsi, place from r where place <= 2""",
    "weekly_atr": f"""with {D}, k as (select symbol, date_trunc('week', ts)::timestamp as ts, max(high) as high, min(low) as low, arg_max(close, ts) as close from bars group by 1, date_trunc('week', ts) having date_trunc('week', ts) + interval 7 day <= timestamp '{AS_OF}'),
 t as (select symbol, ts, case when lag(close) over w is not null then greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr from k {_W})
 select symbol, ts, round(case when count(tr) over x = 10 then avg(tr) over x end, 5) as atr from t window x as (partition by symbol order by ts rows between 9 preceding and current row)""",
}
_FINE = {k: SQL[k].replace(", 6) as f_", ", 15) as f_").replace(", 5) as f_", ", 15) as f_").replace(", 5) as roro", ", 15) as roro") for k in ("risk_features", "ema_trend", "adx_roro")}
_CLIP = "greatest(-1, least(1, {0}))"
SQL["roro_composite"] = f"""with rf as ({_FINE['risk_features']}), et as (select symbol, ts, f_trend from ({_FINE['ema_trend']})), rd as ({_FINE['adx_roro']}), {H},
 p as (select symbol, ts, row_number() over {_W.replace('window w as ', '')} as seen, min(case when high = low then 1 else 0 end) over {_W.replace('window w as ', '')} = 1 as flat from bars),
 x as (select p.*, f_trend, f_momentum, f_vol_regime, f_drawdown, f_dir_volume, {_CLIP.format("(case when seen >= 42 then coalesce(roro_adx, 25) else 25 end - 25) / 25")} as f_adx_strength,
   {_CLIP.format("case when seen >= 42 then roro_di_plus - roro_di_minus else 0 end / 30")} as f_di_spread from p join rf using (symbol, ts) join et using (symbol, ts) join rd using (symbol, ts)),
 y as (select *, len(list_filter([f_trend, f_momentum, f_vol_regime, f_drawdown, f_dir_volume], lambda v: v > 0)) + case when flat then 0 else len(list_filter([f_adx_strength, f_di_spread], lambda v: v > 0)) end as n from x)
 select symbol, ts, round(f_trend, 4) + 0::double as f_trend, round(f_momentum, 4) + 0::double as f_momentum, round(f_vol_regime, 4) + 0::double as f_vol_regime, round(f_drawdown, 4) + 0::double as f_drawdown, round(f_dir_volume, 4) + 0::double as f_dir_volume,
   round(f_adx_strength, 4) + 0::double as f_adx_strength, round(f_di_spread, 4) + 0::double as f_di_spread, n as n_positive,
   round((f_trend + f_momentum + f_vol_regime + f_drawdown + f_dir_volume + case when flat then 0 else f_adx_strength + f_di_spread end) / case when flat then 5 else 7 end, 4) + 0::double as roro_composite, n >= 4 as vote_4 from y"""
