"""Swings, volume by price, and levels of support and resistance over candle series.

Every operator is keyed by symbol. Levels and swings of a symbol are few beside its bars, so joins of levels with
bars are equi joins on the symbol with a range condition; clustering works on sorted arrays of a symbol's prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _sql(text: str, **frames: DataFrame | str) -> DataFrame:
    """``text`` over the frames it names in braces; a frame given as text is a step over those before it.

    Steps take the place of WITH where a result may be used several times in one plan: Spark tells the definitions of a
    WITH by a number that all copies share, and mixes them up when it puts them in (an error, depending on the plan's ids).
    """
    session, known = next(f for f in frames.values() if isinstance(f, DataFrame)).sparkSession, {}
    for name, f in frames.items():
        known[name] = session.sql(f, **known) if isinstance(f, str) else f
    return session.sql(text, **known)


def _numbered(bars: DataFrame) -> DataFrame:
    return _sql("select *, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n, greatest(open, close) as top, least(open, close) as bottom from {bars}", bars=bars)


def extrema(bars: DataFrame, order: int, strict: bool = True) -> DataFrame:
    """``symbol, i, kind, price`` where the high (low) is the extreme of ``order`` bars on either side.

    Strict extrema need a bar on both sides; others may lie at the ends, with what neighbours there are.
    """
    op, edge = (">", "false") if strict else (">=", "true")
    return _sql(
        f"""select symbol, i, kind, price from (select symbol, i, stack(2, 'high', high, coalesce(high {op} ph, {edge}) and coalesce(high {op} nh, {edge}),
              'low', low, coalesce(pl {op} low, {edge}) and coalesce(nl {op} low, {edge})) as (kind, price, hit)
            from (select *, max(high) over p as ph, max(high) over q as nh, min(low) over p as pl, min(low) over q as nl from {{bars}}
              window p as (partition by symbol order by i rows between {order} preceding and 1 preceding), q as (partition by symbol order by i rows between 1 following and {order} following)))
            where hit""",
        bars=_numbered(bars),
    )


def _fractal(bars: DataFrame, top: str, bottom: str, half: int) -> DataFrame:
    """Strict extremes with ``half`` bars on both sides."""
    return _sql(
        f"""select symbol, i, n, kind, price from (select symbol, i, n, stack(2, 'high', {top}, {top} > pt and {top} > nt, 'low', {bottom}, {bottom} < pb and {bottom} < nb) as (kind, price, hit)
            from (select *, max({top}) over p as pt, max({top}) over q as nt, min({bottom}) over p as pb, min({bottom}) over q as nb from {{bars}}
              window p as (partition by symbol order by i rows between {half} preceding and 1 preceding), q as (partition by symbol order by i rows between 1 following and {half} following))
            where i >= {half} and i < n - {half}) where hit""",
        bars=_numbered(bars),
    )


def spaced_swings(points: DataFrame, atr: DataFrame, apart: float = 1.0) -> DataFrame:
    """Swings in order (the high of a bar first) without those of less than ``apart`` ATR of movement.

    A swing within that distance of the last kept swing of the other kind is dropped; one within it of the last kept of
    its own kind takes the place of all kept at that price if it goes further, and is dropped otherwise.
    """
    keep = lambda kind: f"struct(concat(s.kept, array(x)) as kept, {'x.price' if kind == 'high' else 's.high'} as high, {'x.price' if kind == 'low' else 's.low'} as low)"
    swap = lambda kind: keep(kind).replace("concat(s.kept,", f"concat(filter(s.kept, v -> not (v.kind = '{kind}' and v.price = s.{kind})),")
    turn = lambda kind, other, op: f"""case when abs(x.price - s.{other}) < least then s when abs(x.price - s.{kind}) < least then if(x.price {op} s.{kind}, {swap(kind)}, s) else {keep(kind)} end"""
    return _sql(
        f"""select symbol, x.i as i, x.n as n, x.kind as kind, x.price as price from (select symbol, explode(if(least > 0, aggregate(all, struct(slice(all, 1, 0) as kept, cast(null as double) as high, cast(null as double) as low),
              (s, x) -> if(x.kind = 'high', {turn('high', 'low', '>')}, {turn('low', 'high', '<')})).kept, all)) as x
            from (select p.symbol, a.atr * {apart} as least, row_number() over (partition by p.symbol order by p.i, p.kind) as nth,
                array_sort(collect_list(struct(p.i, p.kind, p.n, p.price)) over (partition by p.symbol)) as all from {{points}} p join {{atr}} a on a.symbol = p.symbol) where nth = 1)""",
        points=points,
        atr=atr,
    )


def swings(bars: DataFrame, atr: DataFrame, window: int = 5, apart: float = 1.0) -> DataFrame:
    """Body swings, and the wick swings that no body swing of the symbol lies within ``apart`` ATR of, spaced by as much."""
    body = _fractal(bars, "top", "bottom", window // 2)
    # the nearest body swings in price, below and above, instead of a comparison with all of them
    wick = _sql(
        f"""select m.symbol, i, n, kind, price from {{m}} m join {{atr}} a on a.symbol = m.symbol
            where not body and not coalesce(price - below < a.atr * {apart}, false) and not coalesce(above - price < a.atr * {apart}, false)""",
        body=body,
        wick=_fractal(bars, "high", "low", window // 2),
        atr=atr,
        u="select symbol, i, n, kind, price, false as body from {wick} union all select symbol, i, n, kind, price, true from {body}",
        m="""select *, max(if(body, price, null)) over (partition by symbol order by price range between unbounded preceding and current row) as below,
                min(if(body, price, null)) over (partition by symbol order by price range between current row and unbounded following) as above from {u}""",
    )
    return _sql(
        "select symbol, i, n, kind, price, 'body' as source from {body} union all select symbol, i, n, kind, price, 'wick' from {wick}",
        body=body,
        wick=spaced_swings(wick, atr, apart),
    )


def swing_roles(points: DataFrame) -> DataFrame:
    """Higher or lower than the previous swing of its kind (HH, LH, HL, LL), and whether it breaks or turns structure.

    It turns structure (CHOCH) when an HH or LL has been before and the swing before it points the other way.
    """
    return _sql(
        "select symbol, i, n, kind, price, source, role, if(known = 1 and lag(side) over (partition by symbol order by i, kind, source) <> side, 'CHOCH', 'BOS') as structural from {o}",
        points=points,
        r="""select *, case when kind = 'high' then if(coalesce(price > before, true), 'HH', 'LH') else if(coalesce(price > before, true), 'HL', 'LL') end as role
             from (select *, lag(price) over (partition by symbol, kind order by i, source) as before from {points})""",
        o="select *, if(role in ('HH', 'HL'), 1, -1) as side, max(if(role in ('HH', 'LL'), 1, 0)) over (partition by symbol order by i, kind, source rows between unbounded preceding and 1 preceding) as known from {r}",
    )


def _sums_beyond(lines: DataFrame, bars: DataFrame, near: int = 6) -> DataFrame:
    """For each line ``symbol, i, kind, source, line`` the sum ``w`` of the weights of later bars whose close lies beyond it.

    The bars behind a line are cut into ranges of twofold size, as many as their number has binary digits: in each range
    bars and lines stand in order of price, and one running sum answers all lines. The first, short range (up to
    ``2 ** near`` bars) is compared bar by bar. ``bars``: ``symbol, i, n, close, weight``.
    """
    ranges = f"sequence({near}, 40)"
    first = _sql(
        f"""select l.symbol, l.i, l.kind, l.source, sum(b.weight) as w from {{lines}} l join {{bars}} b on b.symbol = l.symbol and shiftright(b.i, {near}) = shiftright(l.i, {near})
            where b.i > l.i and if(l.kind = 'high', b.close > l.line, b.close < l.line) group by l.symbol, l.i, l.kind, l.source""",
        lines=lines,
        bars=bars,
    )
    far = _sql(
        "select symbol, i, kind, source, sum(upto) as w from {r} where weight is null group by symbol, i, kind, source",
        lines=lines,
        bars=bars,
        a=f"""select symbol, i, kind, source, line as value, cast(null as double) as weight, explode(transform(filter({ranges},
                l -> shiftright(i, l) % 2 = 0 and shiftleft(shiftright(i, l) + 1, l) < n), l -> struct(l as level, shiftright(i, l) + 1 as place))) as x from {{lines}}""",
        b=f"select symbol, close, weight, explode(transform(filter({ranges}, l -> shiftright(i, l) % 2 = 1), l -> struct(l as level, shiftright(i, l) as place))) as x from {{bars}}",
        u="select * from {a} union all select symbol, cast(null as bigint), 'high', null, close, weight, x from {b} union all select symbol, null, 'low', null, close, weight, x from {b}",
        r="select *, sum(weight) over (partition by symbol, kind, x.level, x.place order by if(kind = 'high', -value, value), if(weight is null, 0, 1) rows unbounded preceding) as upto from {u}",
    )
    return first.unionByName(far)


def break_counts(points: DataFrame, bars: DataFrame, atr: DataFrame, beyond: float = 0.25, most_volume: float = 2.0, in_a_row: int = 2) -> DataFrame:
    """How often later closes lie beyond a swing: ``breaks`` weighted by relative volume, and ``killed`` if ``in_a_row``
    of them follow each other.

    The newest swing of either kind is shielded: it has no breaks. No swing is compared with all later bars: for the sum
    see :func:`_sums_beyond`; for the run, the best of what follows decides (the largest, over the bars behind the swing,
    of the least of ``in_a_row`` closes).
    """
    rows = _sql(
        """select symbol, cast(i as bigint) as i, n, close, weight, max(lowest) over a as best_high, min(highest) over a as best_low from {r}
              window a as (partition by symbol order by i rows between 1 following and unbounded following)""",
        bars=_numbered(bars),
        v=f"select *, least(volume / greatest(avg(volume) over (partition by symbol), 1e-12), {most_volume}) as weight from {{bars}}",
        r=f"""select *, if(count(*) over w = {in_a_row}, min(close) over w, null) as lowest, if(count(*) over w = {in_a_row}, max(close) over w, null) as highest from {{v}}
              window w as (partition by symbol order by i rows between current row and {in_a_row - 1} following)""",
    )
    lines = _sql(
        f"""select p.symbol, cast(p.i as bigint) as i, p.n, p.kind, p.source, p.price, p.price + if(p.kind = 'high', {beyond}, -{beyond}) * a.atr as line, p.i = max(p.i) over (partition by p.symbol, p.kind) as newest
            from {{points}} p join {{atr}} a on a.symbol = p.symbol""",
        points=points,
        atr=atr,
    )
    sums = _sums_beyond(lines.where("not newest").drop("newest", "price"), rows).groupBy("symbol", "i", "kind", "source").agg(F.sum("w").alias("w"))
    return _sql(
        """select s.symbol, s.i, s.kind, s.source, s.price, coalesce(w.w, 0.0D) as breaks, not s.newest and coalesce(if(s.kind = 'high', b.best_high > s.line, b.best_low < s.line), false) as killed
           from {lines} s left join {bars} b on b.symbol = s.symbol and b.i = s.i left join {sums} w on w.symbol = s.symbol and w.i = s.i and w.kind = s.kind and w.source = s.source""",
        lines=lines,
        bars=rows,
        sums=sums,
    )


def volume_profile(bars: DataFrame, bins: int = 50, half_life: str = "greatest(n div 3, 10)") -> DataFrame:
    """``symbol, bin, center, volume``: each bar's volume, halved every ``half_life`` bars back, spread evenly over
    the bins whose centres its range covers. Every bin from 0 to ``bins - 1`` has a row."""
    return _sql(
        f"""with b as (select *, min(low) over (partition by symbol) as lo, max(high) over (partition by symbol) as hi from {{bars}}),
            s as (select symbol, volume * exp(-ln(2) * (n - 1 - i) / {half_life}) as w, lo, (hi - lo) / {bins} as step,
                greatest(ceil((low - lo) / nullif((hi - lo) / {bins}, 0) - 0.5), 0) as a, least(floor((high - lo) / nullif((hi - lo) / {bins}, 0) - 0.5), {bins - 1}) as z from b),
            e as (select symbol, w / (z - a + 1) as w, explode(sequence(a, z)) as bin from s where z >= a),
            v as (select symbol, bin, sum(w) as w from e group by symbol, bin),
            d as (select symbol, lo, step, explode(sequence(0L, {bins - 1}L)) as bin from (select symbol, min(lo) as lo, min(step) as step from s group by symbol))
            select d.symbol, d.bin, d.lo + d.step * (d.bin + 0.5D) as center, round(coalesce(v.w, 0.0), 9) as volume from d left join v on v.symbol = d.symbol and v.bin = d.bin""",
        bars=_numbered(bars),
    )


def value_area(profile: DataFrame, share: float = 0.70) -> DataFrame:
    """Point of control (first of the largest bins) and the bounds of the value area around it, grown bin by bin
    towards the larger neighbour (the lower one among equals) until it holds ``share`` of the volume."""
    return _sql(
        f"""with a as (select symbol, transform(array_sort(collect_list(struct(bin, center, volume))), x -> x) as b from {{profile}} group by symbol),
            p as (select *, transform(b, x -> x.volume) as v from a), m as (select *, array_position(v, array_max(v)) - 1 as poc, aggregate(v, 0.0D, (s, x) -> s + x) as total from p),
            g as (select *, aggregate(b, struct(cast(poc as int) as lo, cast(poc as int) as hi, v[cast(poc as int)] as got), (s, x) ->
                case when s.got >= total * {share} then s
                  when s.lo > 0 and v[s.lo - 1] >= if(s.hi < size(v) - 1, v[least(s.hi + 1, size(v) - 1)], 0.0D) then struct(s.lo - 1 as lo, s.hi as hi, s.got + v[s.lo - 1] as got)
                  when s.hi < size(v) - 1 then struct(s.lo as lo, s.hi + 1 as hi, s.got + v[s.hi + 1] as got) else s end) as f from m)
            select symbol, b[cast(poc as int)].center as poc, b[f.lo].center as low, b[f.hi].center as high, f.got / nullif(total, 0) as share from g""",
        profile=profile,
    )


def high_volume_nodes(profile: DataFrame, percent: float = 0.75, order: int = 3) -> DataFrame:
    """Peaks of the profile smoothed over bins (mirrored at the ends) that reach the percentile of the unsmoothed."""
    return _sql(
        f"""with n as (select *, count(*) over (partition by symbol) as bins from {{profile}}), k as (select *, greatest(3, bins div 20) as size from n),
            m as (select symbol, bin, volume, center, size, bins, 0 as copy from k union all select symbol, -1 - bin, volume, null, size, bins, 1 from k where bin < size
              union all select symbol, 2 * bins - 1 - bin, volume, null, size, bins, 1 from k where bin >= bins - size),
            s as (select a.symbol, a.bin, a.center, round(avg(b.volume), 6) as smooth from m a join m b on a.symbol = b.symbol and b.bin between a.bin - a.size div 2 and a.bin - a.size div 2 + a.size - 1
              where a.copy = 0 group by a.symbol, a.bin, a.center),
            t as (select symbol, percentile(volume, {percent}) as least from {{profile}} group by symbol),
            w as (select s.*, max(smooth) over (partition by symbol) as top, max(smooth) over (partition by symbol order by bin rows between {order} preceding and 1 preceding) as l,
              max(smooth) over (partition by symbol order by bin rows between 1 following and {order} following) as r from s)
            select w.symbol, w.bin, w.center as price, w.smooth / nullif(w.top, 0) as weight from w join t on t.symbol = w.symbol where smooth > l and smooth > r and smooth >= least""",
        profile=profile,
    )


def gap_clusters(points: DataFrame, gap: str, price: str = "price", key: str = "symbol") -> DataFrame:
    """Adds ``cluster``: a new one wherever ``gap`` holds between ``x`` and the value ``y`` before it."""
    return _sql(
        f"""select * except (x, y), sum(if(coalesce({gap}, true), 1, 0)) over (partition by {key} order by x rows unbounded preceding) as cluster
            from (select *, {price} as x, lag({price}) over (partition by {key} order by {price}) as y from {{points}})""",
        points=points,
    )


def anchored_clusters(points: DataFrame, near: str, price: str = "price", key: str = "symbol", extra: str = "") -> DataFrame:
    """Adds ``anchor``: all values for which ``near`` holds between value ``x`` and the lowest value ``a`` of the cluster.

    ``extra`` names a column that is constant within a key and used in ``near``.
    """
    more = f", max({extra}) as {extra}" if extra else ""
    return _sql(
        f"""with k as (select {key} as k, array_sort(collect_set({price})) as xs{more} from {{points}} group by {key}),
            a as (select k, explode(aggregate(xs, cast(array() as array<double>), (s, x) -> if(size(s) > 0 and exists(slice(s, -1, 1), a -> coalesce({near}, false)), s, concat(s, array(x))))) as anchor from k),
            u as (select struct(p.*) as p, {key} as k, {price} as x, cast(null as double) as anchor from {{points}} p union all select null, k, anchor, anchor from a)
            select p.*, anchor from (select p, max(anchor) over (partition by k order by x range between unbounded preceding and current row) as anchor from u) where p is not null""",
        points=points,
    )


def touch_levels(bars: DataFrame, close_tol: float = 0.005, wick_tol: float = 0.01, least: float = 1.5, orders: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """Levels at clusters of lows and highs, scored by the bars that touch them, the recent ones more."""
    found = [extrema(bars, o, strict=False).select("symbol", "price") for o in orders]
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    grouped = gap_clusters(union.distinct(), f"(x - y) / nullif(y, 0) >= {wick_tol}")
    # bars meet levels by bins of the price's logarithm, as wide as the tolerance
    return _sql(
        f"""select s.symbol, level as price, if(level < c.price, 'support', 'resistance') as side,
              round(least(1.0, 0.6 * score / greatest(0.01, max(score) over (partition by s.symbol)) + 0.4 * recency), 4) as strength, touches, round(recency, 4) as recency, anchor_bar
            from {{s}} s join {{c}} c on c.symbol = s.symbol where score >= {least}""",
        grouped=grouped,
        bars=_numbered(bars),
        l="select symbol, cluster, percentile(price, 0.5) as level from {grouped} group by symbol, cluster",
        lb=f"select *, if(level > 0, cast(floor(ln(level) / {wick_tol}) as bigint), 0L) as bin from {{l}}",
        bb=f"""select *, explode(if(low > 0, sequence(cast(floor(ln(low / {1 + wick_tol}) / {wick_tol}) as bigint) - 1, cast(floor(ln(high / {1 - wick_tol}) / {wick_tol}) as bigint) + 1), array(0L))) as bin from {{bars}}""",
        t=f"""select l.symbol, l.level, b.i, b.n, exp(-ln(2) * (b.n - 1 - b.i) / greatest(b.n div 3, 5)) as recent,
                case when abs(b.close - level) <= level * {close_tol} then 1.0 when abs(b.open - level) <= level * {close_tol} then 0.7
                  when b.low between level - level * {wick_tol} and level then 0.3 when b.high between level and level + level * {wick_tol} then 0.3 end as weight
              from {{lb}} l join {{bb}} b on b.symbol = l.symbol and b.bin = l.bin and b.low <= level * {1 + wick_tol} and b.high >= level * {1 - wick_tol}""",
        s="select symbol, level, sum(weight * recent) as score, count(*) as touches, avg(recent) as recency, max_by(i, struct(weight * recent, -i)) as anchor_bar from {t} where weight is not null group by symbol, level",
        c="select symbol, max_by(close, i) as price from {bars} group by symbol",
    )


def body_edge_levels(bars: DataFrame, atr_bars: DataFrame, atr: DataFrame, times: float = 1.5, half_life: int = 40) -> DataFrame:
    """Levels at the opens of large bodies, clustered within one ATR of the lowest; the largest body gives the price.

    ``atr_bars``: ``symbol, ts, atr`` a bar; ``atr``: ``symbol, atr`` of the last bars.
    """
    big = _sql(
        f"""select b.symbol, b.i, b.n, b.open as price, abs(b.close - b.open) as body, if(b.close > b.open, 'support', 'resistance') as side, concat(b.symbol, '|', if(b.close > b.open, 's', 'r')) as k, a.atr
            from {{bars}} b join {{atr_bars}} t on t.symbol = b.symbol and t.ts = b.ts join {{atr}} a on a.symbol = b.symbol where abs(b.close - b.open) > t.atr * {times}""",
        bars=_numbered(bars),
        atr_bars=atr_bars,
        atr=atr,
    )
    return _sql(
        f"""with c as (select symbol, max_by(close, ts) as last from {{bars}} group by symbol),
            g as (select symbol, side, anchor, max_by(price, struct(body, -price, -i)) as price, count(*) as touches, avg(exp(-ln(2) * (n - 1 - i) / {half_life})) as recency, avg(body) as body from {{big}} group by symbol, side, anchor)
            select g.symbol, side, round(price, 8) as price, touches, round(recency, 4) as recency,
              round(0.4 * least(1.0, touches / 5) + 0.3 * least(1.0, body / nullif(last * 0.03, 0)) + 0.3 * recency, 4) as strength from g join c on c.symbol = g.symbol""",
        big=anchored_clusters(big, "x - a <= atr", key="k", extra="atr"),
        bars=bars,
    )


def flip_levels(bars: DataFrame, atr: DataFrame, tol: float = 0.5, side_touches: int = 2) -> DataFrame:
    """Levels that were touched from one side first and from the other side later, at the best split of the touches."""
    edges = _sql(
        """with m as (select *, avg(abs(close - open)) over (partition by symbol) as body from {bars}),
           x as (select symbol, explode(array(top, bottom)) as price from m where abs(close - open) >= body * 0.5), e as (select distinct symbol, round(price, 8) as price from x) select e.*, a.atr from e join {atr} a on a.symbol = e.symbol""",
        bars=_numbered(bars),
        atr=atr,
    )
    return _sql(
        f"""with l as (select symbol, cluster, avg(price) as level, max(atr) * {tol} as tol from {{grouped}} group by symbol, cluster),
            -- bars meet levels by bins of price, two tolerances wide
            lb as (select *, cast(floor(level / (2 * tol)) as bigint) as bin from l where tol > 0),
            bb as (select b.*, explode(array_distinct(flatten(transform(array(bottom, top), e -> sequence(cast(floor((e - t.tol) / (2 * t.tol)) as bigint), cast(floor((e + t.tol) / (2 * t.tol)) as bigint)))))) as bin
              from {{bars}} b join (select symbol, max(tol) as tol from l where tol > 0 group by symbol) t on t.symbol = b.symbol),
            t as (select l.symbol, l.level, b.i, b.n, case when b.bottom < level - tol / 2 and b.top > level + tol / 2 then null
                when abs(b.bottom - level) <= tol and b.close > level + tol / 2 then 'S' when abs(b.top - level) <= tol and b.close < level - tol / 2 then 'R' end as t
              from lb l join bb b on b.symbol = l.symbol and b.bin = l.bin and (abs(b.bottom - level) <= tol or abs(b.top - level) <= tol)),
            u as (select *, row_number() over o as k, count(*) over p as m, sum(if(t = 'S', 1, 0)) over (partition by symbol, level order by i rows between unbounded preceding and 1 preceding) as s_before,
                sum(if(t = 'R', 1, 0)) over (partition by symbol, level order by i rows between unbounded preceding and 1 preceding) as r_before, sum(if(t = 'S', 1, 0)) over p as s_all, sum(if(t = 'R', 1, 0)) over p as r_all, max(i) over p as last_i
              from t where t is not null window o as (partition by symbol, level order by i), p as (partition by symbol, level)),
            f as (select *, explode(array(struct('S_to_R' as flip, s_before as s, r_all - r_before as r, 0 as o), struct('R_to_S' as flip, s_all - s_before as s, r_before as r, 1 as o))) as x
              from u where m >= {2 * side_touches} and k > {side_touches} and k <= m - {side_touches} + 1),
            b as (select *, row_number() over (partition by symbol, level order by x.s + x.r desc, k, x.o) as place from f where x.s >= {side_touches} and x.r >= {side_touches}),
            c as (select symbol, max_by(close, i) as last from {{bars}} group by symbol)
            select b.symbol, round(level, 8) as price, x.flip as flip, case when x.flip = 'S_to_R' and level < last * 0.97 then 'support' when x.flip = 'R_to_S' and level > last * 1.03 then 'resistance'
                when x.flip = 'S_to_R' then 'resistance' else 'support' end as side, x.s + x.r as touches, i as flip_bar, round(1.0D - (n - 1 - last_i) / n, 4) as recency,
              round(least(1.0D, 0.4D * least(1.0D, (x.s + x.r) / 10) + 0.3D * least(1.0D, least(x.s, x.r) / 3) + 0.3D * (1.0D - (n - 1 - last_i) / n)), 4) as strength
            from b join c on c.symbol = b.symbol where place = 1""",
        grouped=gap_clusters(edges, f"x - y >= atr * {tol}"),
        bars=_numbered(bars),
    )


def merged_levels(levels: DataFrame, prices: DataFrame, near: float = 0.005, most: int = 20, least: float = 0.10) -> DataFrame:
    """Levels of several methods joined where they lie within ``near`` of the lowest of their group.

    ``levels``: ``symbol, price, strength, method, touches, recency, role, body``; ``prices``: ``symbol, last``. The price is the
    mean weighted by strength (bodies count 1.5 times); the strength adds up by method, with bonuses for agreement. ``snap``
    is the lowest price of a support's members and the highest of a resistance's, ``wick`` whether the strongest is one.
    """
    # Fixed values in the text: weights of the methods, bonuses, and the order of roles.
    return _sql(
        f"""with g as (select symbol, anchor, sum(price * strength * if(body, 1.5D, 1.0D)) / sum(strength * if(body, 1.5D, 1.0D)) as price,
                sum(strength * case method when 'market_structure' then 0.40D when 'touch_count' then 0.25D when 'nison_body' then 0.15D else 0.10D end) as base,
                count(distinct method) as methods, max(if(method = 'polarity_flip', 1, 0)) as flips, sum(touches) as touches, max(recency) as recency, concat_ws('+', array_sort(collect_set(method))) as method,
                max_by(body, struct(strength, body, -price)) as body, min(price) as lowest, max(price) as highest,
                min_by(role, struct(case when role like '%CHOCH%' then 0 when role like '%flip%' then 1 when role like '%BOS%' then 2 else 9 end, price, method, role)) as role
              from {{levels}} group by symbol, anchor),
            s as (select g.*, round(least(1.0D, least(1.0D, base + least(0.30D, (methods - 1) * 0.10D)) + flips * 0.10D) + 1e-9D, 4) as strength from g)
            select s.symbol, round(price, 8) as price, if(price < p.last, 'support', 'resistance') as side, strength, method, touches, recency, role, if(price < p.last, lowest, highest) as snap, not body as wick,
              row_number() over (partition by s.symbol order by strength desc, price) as place
            from s join {{prices}} p on p.symbol = s.symbol where strength >= {least}""",
        levels=anchored_clusters(levels, f"(x - a) / nullif(a, 0) <= {near}"),
        prices=prices,
    ).where(f"place <= {most}")


def structure_levels(roles: DataFrame, breaks: DataFrame, half_life: float = 30.0) -> DataFrame:
    """Levels of swings that later closes have not invalidated, and weak ones of opposite side where they broke.

    A swing ends with two closes beyond it in a row or three weighted breaks; from two weighted breaks on it also
    acts from the other side. Strength: by structural role, recent ones more, less for each break. ``structural`` has
    role and structure in one (``HH_BOS``, ``flipped_support``).
    """
    # Fixed values in the text: base strengths by role and how they fall with breaks.
    return _sql(
        """select symbol, i as bar, price, source, if((kind = 'low') <> x.flipped, 'support', 'resistance') as side, x.flipped as flipped, if(x.flipped, 'flip', if(structural = 'CHOCH', 'CHOCH', role)) as role,
              if(x.flipped, if(kind = 'high', 'flipped_resistance', 'flipped_support'), concat(role, '_', structural)) as structural, round(recency, 4) as recency,
              round((x.base * w * 0.7D + recency * 0.3D) * x.left + 1e-9D, 4) as strength, x.touches as touches from {a}""",
        roles=roles,
        breaks=breaks,
        j=f"""select r.*, b.breaks, b.killed, exp(-(r.n - 1 - r.i) / {half_life}) as recency, if(r.source = 'wick', 0.85D, 1.0D) as w from {{roles}} r join {{breaks}} b
              on b.symbol = r.symbol and b.i = r.i and b.kind = r.kind and b.source = r.source""",
        a="""select *, explode(filter(array(
                struct(false as flipped, not killed and breaks < 3 as here, case when structural = 'CHOCH' then 0.85D when role in ('HL', 'LH') then 0.65D else 0.45D end as base,
                  case when breaks >= 3 then 0.1D when breaks <= 0 then 1.0D else greatest(0.1D, 1 - 0.3D * breaks) end as left, 1 + cast(floor(breaks) as bigint) as touches),
                struct(true as flipped, breaks >= 2 as here, 0.30D as base, 1.0D as left, 1L as touches)), x -> x.here)) as x from {j}""",
    )
