"""Queries of the general data problems (p1 to p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.deliveries import first_deliveries, new_messages, repeated_deliveries
from tidemark.operators.outliers import implausible_bars
from tidemark.operators.periods import covered_periods, trade_intervals
from tidemark.operators.regular import regular_grid
from tidemark.operators.trailing import trailing_periods
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_deliveries(table(spark, d, "candle_deliveries"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    return first_deliveries(table(spark, d, "candle_deliveries"))


def p1_new_batches(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the later batches that none of the earlier ones, taken as stored, has.

    The later ones begin half way between the first and the last batch; a row without batch counts as new.
    """
    rows = table(spark, d, "candle_deliveries")
    # a scalar subquery over the same table
    half = table(spark, d, "candle_deliveries").select(((F.min("batch_id") + F.max("batch_id")) / 2).alias("half")).scalar()
    cut = rows.withColumn("later", F.coalesce(F.col("batch_id") > half, F.lit(True)))
    return new_messages(cut.where("later").drop("later"), cut.where("not later").drop("later"))


def p2_trailing(spark: SparkSession, d: str) -> DataFrame:
    return trailing_periods(table(spark, d, "daily_candles"))


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible_bars(table(spark, d, "hourly_candles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_flags(spark, d).select("candle_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    days = trade_intervals(table(spark, d, "trades"), table(spark, d, "backtest_runs"), table(spark, d, "tokens"))
    spans = covered_periods(days, ["run_id", "symbol"])
    return spans.select("run_id", "symbol", "kind", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "price_ticks"), table(spark, d, "feeds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    grid = p5_grid(spark, d)
    return grid.where("missing").select("feed_id", F.date_format("slot_start", "yyyy-MM-dd HH:mm:ss").alias("slot_start"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_new_batches, p2_trailing, p3_found, p3_flags, p4_found, p5_found, p5_grid)}

_ID = r"""
with typed as (
  select *, lower(regexp_replace(message_id, '^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$', '', 'g')) as m from candle_deliveries
), named as (
  select *, regexp_replace(case when regexp_full_match(replace(m, '-', ''), '[0-9a-f]{32}') then replace(m, '-', '')
      when regexp_full_match(m, '[0-9]+') then coalesce(nullif(ltrim(m, '0'), ''), '0') else m end, '^$', '') as k from typed
)
"""
_KEPT_COLUMNS = "delivery_id, batch_id, source, message_id, feed_id, symbol, ts, open, high, low, close, volume, received_at"
_DAY = r"""case when regexp_matches(trim({0}), '^\d{{4}}-\d{{2}}-\d{{2}}') then try_cast(substr(trim({0}), 1, 10) as date)
  when regexp_matches(trim({0}), '^\d{{4}}/\d{{2}}/\d{{2}}$') then try_cast(replace(trim({0}), '/', '-') as date)
  when regexp_matches(trim({0}), '^\d{{8}}$') then try_strptime(trim({0}), '%Y%m%d')::date
  else try_strptime(trim({0}), '%d %b %Y')::date end"""

SQL = {
    "p1_found": _ID + "select delivery_id from (select delivery_id, row_number() over (partition by source, k order by delivery_id) as r from named where k <> '') where r > 1",
    "p1_kept": _ID + f"select {_KEPT_COLUMNS} from (select *, row_number() over (partition by source, k, case when k is null or k = '' then delivery_id end order by delivery_id) as r from named) where r = 1",
    "p1_new_batches": _ID
    + f""", cut as (select *, coalesce(batch_id > (select (min(batch_id) + max(batch_id)) / 2 from candle_deliveries), true) as later from named)
     select {_KEPT_COLUMNS} from (select *, row_number() over (partition by source, k, case when k is null or k = '' then delivery_id end order by delivery_id) as r
       from cut where later) a where r = 1 and not exists (select 1 from cut b where not b.later and b.source = a.source and b.k = a.k and b.k <> '')""",
    "p2_trailing": """
with ranked as (select *, row_number() over (partition by feed_id, ts order by loaded_at desc nulls last, volume desc nulls last, close desc nulls last) as r from daily_candles where feed_id is not null and ts is not null),
 bars as (select feed_id, ts, volume, close, cast(cast(volume as varchar) as decimal(33,12)) as dv, cast(cast(close as varchar) as decimal(33,12)) as dc from ranked where r = 1),
 daily as (select feed_id, cast(ts as date) as day, sum(dv) as v, sum(dc) as c, sum(volume - dv::double) as rv, sum(close - dc::double) as rc, count(close) as nc, count(*) as n from bars group by all),
 ends as (select feed_id, min(day) as a, max(day) as b from daily group by 1),
 days as (select feed_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
 w as (select d.feed_id, d.day, coalesce(n, 0) as bars, coalesce(v, 0) as v, coalesce(c, 0) as c, coalesce(rv, 0) as rv, coalesce(rc, 0) as rc, coalesce(nc, 0) as nc from days d left join daily using (feed_id, day))
select feed_id, strftime(day, '%Y-%m-%d') as day, cast(bars as bigint) as bars,
  cast(sum(bars) over s as bigint) as bars_7, cast(cast(sum(v) over s as varchar) as double) + sum(rv) over s as volume_total_7, case when sum(nc) over s > 0 then (cast(cast(sum(c) over s as varchar) as double) + sum(rc) over s) / cast(sum(nc) over s as double) end as close_avg_7,
  cast(sum(bars) over l as bigint) as bars_30, cast(cast(sum(v) over l as varchar) as double) + sum(rv) over l as volume_total_30, case when sum(nc) over l > 0 then (cast(cast(sum(c) over l as varchar) as double) + sum(rc) over l) / cast(sum(nc) over l as double) end as close_avg_30
from w window s as (partition by feed_id order by day rows between 6 preceding and current row), l as (partition by feed_id order by day rows between 29 preceding and current row)""",
    "p4_found": f"""
with t as (select run_id, upper(trim(symbol)) as w, {_DAY.format('entry_date')} as a, {_DAY.format('exit_date')} as x, coalesce(trim(exit_date), '') = '' as open from trades),
 n as (select t.run_id, coalesce(k.symbol, w) as symbol, a, case when open then cast(r.end_date as date) else x end as b
   from t left join (select w, min(named) as symbol from (select symbol as named, upper(trim(unnest([symbol, pair, id]))) as w from tokens) group by w) k using (w) left join backtest_runs r using (run_id)),
 o as (select *, max(b) over (partition by run_id, symbol order by a, b rows between unbounded preceding and 1 preceding) as before from (select distinct * from n where b >= a)),
 i as (select *, sum(case when before is null or a > before + 1 then 1 else 0 end) over (partition by run_id, symbol order by a, b) as g from o),
 p as (select run_id, symbol, min(a) as a, max(b) as b from i group by run_id, symbol, g),
 q as (select *, lead(a) over (partition by run_id, symbol order by a) as following from p)
select run_id, symbol, 'period' as kind, strftime(a, '%Y-%m-%d') as first_day, strftime(b, '%Y-%m-%d') as last_day from q
union all select run_id, symbol, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(following - 1, '%Y-%m-%d') from q where following is not null""",
    "p5_found": """
with r as (select feed_id, step_minutes::bigint * 60000000 as step, epoch_us(ts) // (step_minutes::bigint * 60000000) as slot from price_ticks join feeds using (feed_id) where close > 0),
 e as (select feed_id, step, min(slot) as a, max(slot) as b from r group by all),
 g as (select feed_id, step, unnest(generate_series(a, b)) as slot from e)
select feed_id, strftime(make_timestamp(slot * step), '%Y-%m-%d %H:%M:%S') as slot_start from g anti join r using (feed_id, slot)""",
}
