"""Queries on fills, positions and profit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.operators import book, fills
from ticklake.operators.joins import asof, running_sum
from ticklake.operators.kept import kept
from ticklake.operators.quantiles import quantiles
from ticklake.operators.ranges import neighbour, running
from ticklake.plans.bridge import query

SECOND = 1_000_000
_QUOTES = ", quotes as (select * from (select *, row(bid, ask) is distinct from lag(row(bid, ask)) over (partition by ticker, epoch order by ord) as changed from books where bid is not null and ask is not null) where changed)"
_HITS = _QUOTES + """, hits as (select t.*, q.bid, q.ask, q.mid_x2, q.ord as asof_on, case when taker = 'no' and t.price <= q.bid then 'buy' when taker = 'yes' and t.price >= q.ask then 'sell' end as fill_side
  from trades t asof join quotes q on t.ticker = q.ticker and t.ord > q.ord), passive as (select * from hits where fill_side is not null)"""
_RANKED = ", ranked as (select *, row_number() over (partition by ticker, side order by ord) as rn from fills)"
_FEE = "greatest(1, cast(floor(0.0175 * {0} * (100 - {0}) / 100) as int))"
_TRIPS = _RANKED + f""", trips as (select b.ticker, b.rn, b.ord as buy_ord, b.price as buy_price, s.ord as sell_ord, s.price as sell_price,
  {_FEE.format('b.price')} + {_FEE.format('s.price')} as fee, s.price - b.price - {_FEE.format('b.price')} - {_FEE.format('s.price')} as pnl
  from ranked b join ranked s on b.ticker = s.ticker and b.rn = s.rn and b.side = 'buy' and s.side = 'sell')"""
_OPEN = _RANKED + ", counts as (select ticker, count(*) filter (side = 'buy') as buys, count(*) filter (side = 'sell') as sells from fills group by ticker), opened as (select r.* from ranked r join counts c using (ticker) where r.rn > least(buys, sells))"
_SIGNED = ", signed as (select *, case when side = 'buy' then n else -n end as s from fills), running as (select *, sum(s) over (partition by ticker order by ord) as after from signed)"


def _quotes(t):
    return fills.quote_changes(book.best(book.valid_books(book.depth(t.frames)))).select("ticker", "ord", "bid", "ask", "mid_x2")


@query("b17_passive_fills", _HITS + "select ticker, ord, price, size, fill_side, bid, ask from passive")
def _(t):
    return fills.passive_fills(t.trades, _quotes(t)).select("ticker", "ord", "price", "size", "fill_side", "bid", "ask")


@query("j03_horizon_mids", _QUOTES + ", h as (select t.ticker, t.ord, p.horizon, t.ord + p.horizon::bigint * 1000000 as later from trades t, (values (1), (600), (3600)) p(horizon)) select h.ticker, h.ord, h.horizon, q.mid_x2 as mid_later from h asof left join quotes q on h.ticker = q.ticker and h.later >= q.ord")
def _(t):
    return fills.horizon_mids(t.trades.select("ticker", "ord"), _quotes(t), [1, 600, 3600], SECOND)


@query("j04_book_before_trade", _QUOTES + "select t.ticker, t.ord, q.ord as asof_on, q.bid, q.ask from trades t asof left join quotes q on t.ticker = q.ticker and t.ord > q.ord")
def _(t):
    return asof(t.trades.select("ticker", "ord"), _quotes(t), ["ticker"], "ord", "ord", ["bid", "ask"], exact=False, width=fills.WIDTH)


@query("j05_since_last_change", _QUOTES + "select t.ticker, t.ord, t.ord - q.ord as since from trades t asof left join quotes q on t.ticker = q.ticker and t.ord >= q.ord")
def _(t):
    rows = asof(t.trades.select("ticker", "ord"), _quotes(t), ["ticker"], "ord", "ord", [], width=fills.WIDTH)
    return rows.select("ticker", "ord", (F.col("ord") - F.col("asof_on")).alias("since"))


@query("a48_quote_stability", _QUOTES + ", s as (select t.ord - q.ord as since from trades t asof join quotes q on t.ticker = q.ticker and t.ord >= q.ord) select count(*) as n, median(since) as median_us, round(avg(since), 3) as mean_us, quantile_cont(since, 0.25) as p25_us, quantile_cont(since, 0.75) as p75_us, round(avg(cast(since < 60000000 as int)), 6) as under_minute, round(avg(cast(since < 600000000 as int)), 6) as under_ten, round(avg(cast(since < 3600000000 as int)), 6) as under_hour, round(avg(cast(since < 86400000000 as int)), 6) as under_day from s")
def _(t):
    rows = kept(asof(t.trades.select("ticker", "ord"), _quotes(t), ["ticker"], "ord", "ord", [], width=fills.WIDTH).where("asof_on is not null").select((F.col("ord") - F.col("asof_on")).alias("since")))
    low, middle, high = quantiles(rows, "since", [0.25, 0.5, 0.75])
    under = {"under_minute": 60, "under_ten": 600, "under_hour": 3600, "under_day": 86_400}
    shares = [F.round(F.avg((F.col("since") < s * SECOND).cast("int")), 6).alias(n) for n, s in under.items()]
    return rows.agg(F.count("*").alias("n"), F.lit(middle).alias("median_us"), F.round(F.avg("since"), 3).alias("mean_us"), F.lit(low).alias("p25_us"), F.lit(high).alias("p75_us"), *shares)


@query("f11_latency_filter", _QUOTES + ", s as (select t.ord - q.ord as since from trades t asof left join quotes q on t.ticker = q.ticker and t.ord >= q.ord) select p.least, count(*) as n from s, (values (0), (60), (3600)) p(least) where since is null or since >= p.least::bigint * 1000000 group by p.least")
def _(t):
    rows = asof(t.trades.select("ticker", "ord"), _quotes(t), ["ticker"], "ord", "ord", [], width=fills.WIDTH).select((F.col("ord") - F.col("asof_on")).alias("since"))
    each = rows.withColumn("least", F.explode(F.array(F.lit(0), F.lit(60), F.lit(3600))))
    return each.where("since is null or since >= cast(least as bigint) * 1000000").groupBy("least").agg(F.count("*").alias("n"))


@query("x01_adverse_selection", _HITS + f""", h as (select p.*, horizon, p.ord + horizon::bigint * 1000000 as later from passive p, (values (60), (3600)) v(horizon)),
  m as (select h.*, q.mid_x2 as mid_later from h asof left join quotes q on h.ticker = q.ticker and h.later >= q.ord)
  select horizon, fill_side, count(*) as n, round(avg((case fill_side when 'buy' then 1 else -1 end) * (mid_x2 - mid_later) / 2.0), 6) as adverse,
  round(avg((ask - bid) / 2.0 - (case fill_side when 'buy' then 1 else -1 end) * (mid_x2 - mid_later) / 2.0 - {_FEE.format('price')}), 6) as edge from m group by all""")
def _(t):
    quotes = _quotes(t)
    rows = fills.adverse_selection(fills.passive_fills(t.trades, quotes).drop("asof_on"), quotes, [60, 3600], SECOND)
    return rows.groupBy("horizon", "fill_side").agg(F.count("*").alias("n"), F.round(F.avg("adverse"), 6).alias("adverse"), F.round(F.avg("edge"), 6).alias("edge"))


@query("f12_quote_eligibility", """, seen as (select b.ticker, b.ord, b.bid, b.ask, b.spread, (select count(*) from trades t where t.ticker = b.ticker and t.ord < b.ord) as earlier from books b where b.spread is not null)
  select case when spread <= 0 then 'crossed' when bid <= 10 or ask >= 90 then 'extreme_price' when spread / 2.0 - 1 < 1 then 'spread_narrow' when earlier < 20 then 'low_volume' else 'quote' end as reason, count(*) as n from seen group by all""")
def _(t):
    counted = running(t.trades.select("ticker", "ord"), ["ticker"], ["ord"], fills.WIDTH, earlier=("count", F.lit(1)))
    rows = asof(book.best(book.valid_books(book.depth(t.frames))).where("spread is not null").select("ticker", "ord", "bid", "ask", "spread"), counted, ["ticker"], "ord", "ord", ["earlier"], exact=False, width=fills.WIDTH)
    s = F.col("spread")
    reason = F.when(s <= 0, "crossed").when((F.col("bid") <= 10) | (F.col("ask") >= 90), "extreme_price").when(s / 2 - 1 < 1, "spread_narrow").when(F.coalesce("earlier", F.lit(0)) < 20, "low_volume").otherwise("quote")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("j14_round_trips", _TRIPS + "select * from trips")
def _(t):
    return fills.round_trips(t.fills)


@query("a16_round_trip_pnl", _TRIPS + "select ticker, count(*) as n, sum(pnl) as pnl, sum(fee) as fees, round(avg(cast(pnl > 0 as int)), 6) as win_rate from trips group by ticker")
def _(t):
    return fills.round_trips(t.fills).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.sum("fee").alias("fees"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("win_rate"))


@query("o04_best_and_worst", _TRIPS + ", s as (select ticker, sum(pnl) as pnl from trips group by ticker) select * from (select 'best' as kind, * from s order by pnl desc, ticker limit 3) union all select * from (select 'worst' as kind, * from s order by pnl, ticker limit 3)")
def _(t):
    s = fills.round_trips(t.fills).groupBy("ticker").agg(F.sum("pnl").alias("pnl"))
    best = s.orderBy(F.desc("pnl"), "ticker").limit(3).withColumn("kind", F.lit("best"))
    return best.unionByName(s.orderBy("pnl", "ticker").limit(3).withColumn("kind", F.lit("worst")))


@query("j15_unpaired_fills", _OPEN + "select ticker, ord, side, price, rn from opened")
def _(t):
    return fills.unpaired(t.fills).select("ticker", "ord", "side", "price", "rn")


@query("x11_settlement_pnl", _OPEN + ", s as (select o.*, m.result, case when m.result = 'yes' then 100 - price else -price end as b from opened o join markets m using (ticker) where m.result is not null) select ticker, count(*) as n, sum(case when side = 'buy' then b else -b end) as pnl from s group by ticker")
def _(t):
    return fills.settlement_pnl(fills.unpaired(t.fills), t.markets).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


@query("a34_settlement_bounds", _OPEN + ", s as (select ticker, sum(case when side = 'buy' then 100 - price else price end) as best, sum(case when side = 'buy' then -price else price - 100 end) as worst from opened group by ticker) select ticker, best, worst, (best + worst) / 2.0 as even from s")
def _(t):
    buy = F.col("side") == "buy"
    rows = fills.unpaired(t.fills).groupBy("ticker").agg(F.sum(F.when(buy, 100 - F.col("price")).otherwise(F.col("price"))).alias("best"), F.sum(F.when(buy, -F.col("price")).otherwise(F.col("price") - 100)).alias("worst"))
    return rows.withColumn("even", (F.col("best") + F.col("worst")) / 2)


@query("a15_positions", _SIGNED + "select ticker, sum(s) as position from signed group by ticker having sum(s) <> 0")
def _(t):
    return fills.positions(t.fills)


@query("a14_fill_counts", "select day, count(*) as n, count(*) filter (side = 'buy') as buys, count(*) filter (side = 'sell') as sells, count(distinct ticker) as tickers from fills group by day")
def _(t):
    return t.fills.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"), F.countDistinct("ticker").alias("tickers"))


@query("a35_fill_ratio", "select c_mktsegment, count(*) filter (side = 'buy') as buys, count(*) filter (side = 'sell') as sells, round(count(*) filter (side = 'buy') / nullif(count(*) filter (side = 'sell'), 0), 6) as ratio from fills join markets using (ticker) group by c_mktsegment")
def _(t):
    buys, sells = F.count_if(F.col("side") == "buy"), F.count_if(F.col("side") == "sell")
    return t.fills.join(t.markets, "ticker").groupBy("c_mktsegment").agg(buys.alias("buys"), sells.alias("sells"), F.round(F.try_divide(buys, sells), 6).alias("ratio"))


@query("w11_pnl_curve", _TRIPS + ", c as (select ticker, greatest(buy_ord, sell_ord) as ord, pnl from trips), r as (select *, sum(pnl) over (partition by ticker order by ord) as total from c), p as (select *, greatest(0, max(total) over (partition by ticker order by ord)) as peak from r) select ticker, ord, total, peak, peak - total as drawdown from p")
def _(t):
    return fills.pnl_curve(fills.round_trips(t.fills), width=4096)


@query("w12_gross_exposure", _SIGNED + ", g as (select ord, sum(abs(after) - abs(after - s)) over (order by ord) as gross from running) select max(gross) as most, arg_min(ord, (-gross, ord)) as at from g")
def _(t):
    steps = fills.running_position(t.fills, width=4096).withColumn("step", F.abs("after") - F.abs("before"))
    gross = running_sum(steps, "ord", "step", "gross", 4096)
    return gross.agg(F.max("gross").alias("most"), F.min_by("ord", F.struct(-F.col("gross"), "ord")).alias("at"))


@query("w15_position_cap", ", u as (select *, sum(case when side = 'buy' then 1 else -1 end) over (partition by ticker order by ord) as after from fills), m as (select *, coalesce(max(abs(after)) over (partition by ticker order by ord rows between unbounded preceding and 1 preceding), 0) as most from u) select ticker, count(*) as n, sum(price) as paid from m where most < 2 group by ticker")
def _(t):
    return fills.capped(t.fills, 2, width=4096).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("price").alias("paid"))


_COSTS = _SIGNED + """, folds as (select ticker, list({'q': s::double, 'c': price::double, 'e': 0.0::double, 'r': 0.0::double} order by ord) as xs, list(ord order by ord) as os, list(n order by ord) as ns, list(price order by ord) as ps from signed group by ticker),
  at_ as (select *, unnest(range(1, len(os) + 1)) as i from folds), costs as (select ticker, os[i] as ord, ns[i] as n, ps[i] as price, i = len(os) as is_last, list_reduce(list_prepend({'q': 0.0::double, 'c': 0.0::double, 'e': -1.0::double, 'r': 0.0::double}, xs[1:i]), lambda a, x: {'q': a.q + x.q,
    'c': case when a.q + x.q = 0 then 0.0 when a.q * x.q >= 0 then a.c + x.c * x.q when abs(a.q + x.q) < abs(a.q) then a.c * (a.q + x.q) / a.q else a.c end,
    'e': case when a.q + x.q = 0 then -1.0 when a.q * x.q >= 0 then abs((a.c + x.c * x.q) / (a.q + x.q)) else a.e end,
    'r': case when a.q * x.q < 0 then least(abs(a.q), abs(x.q)) * (x.c - a.e) * sign(a.q) else 0.0 end}) as z from at_)"""


@query("w16_entry_prices", _COSTS + "select ticker, ord, cast(z.q as bigint) as position, round(z.c, 6) as cost, round(nullif(z.e, -1), 6) as entry, round(z.r, 6) as realized from costs")
def _(t):
    rows = fills.average_cost(t.fills, width=4096)
    return rows.select("ticker", "ord", F.col("after").cast("bigint").alias("position"), F.round("cost", 6).alias("cost"), F.round("entry", 6).alias("entry"), F.round("realized", 6).alias("realized"))


@query("w16_entry_episodes", _COSTS + ", e as (select *, coalesce(sum(cast(z.q = 0 as int)) over (partition by ticker order by ord rows between unbounded preceding and 1 preceding), 0) as episode from costs) select ticker, cast(episode as bigint) as episode, count(*) as n, round(max(nullif(z.e, -1)), 6) as highest_entry, round(sum(z.r), 6) as realized from e group by all")
def _(t):
    rows = fills.average_cost(t.fills, width=4096).groupBy("ticker", "episode")
    return rows.agg(F.count("*").alias("n"), F.round(F.max("entry"), 6).alias("highest_entry"), F.round(F.sum("realized"), 6).alias("realized"))


@query("w17_emit_on_change", ", x as (select ticker, ord, price, side, lag(row(side, price > 50)) over (partition by ticker order by ord) as b from fills) select ticker, ord, side from x where row(side, price > 50) is distinct from b")
def _(t):
    state = F.struct("side", (F.col("price") > 50).alias("high"))
    told = neighbour(t.fills.withColumn("state", state), ["ticker"], ["ord"], 4096, ["state"], "b")
    return told.where(~F.col("state").eqNullSafe(F.col("b.state"))).select("ticker", "ord", "side")


@query("w18_attribution", _SIGNED + "select ticker % 10 as book, day % 7 as weekday, sum(-s * price) as cash, grouping(ticker % 10) as all_books, grouping(day % 7) as all_days from signed group by cube (ticker % 10, day % 7)")
def _(t):
    signed = F.when(F.col("side") == "buy", F.col("n")).otherwise(-F.col("n"))
    rows = t.fills.select((F.col("ticker") % 10).alias("book"), (F.col("day") % 7).alias("weekday"), (-signed * F.col("price")).alias("c"))
    return rows.cube("book", "weekday").agg(F.sum("c").alias("cash"), F.grouping("book").cast("int").alias("all_books"), F.grouping("weekday").cast("int").alias("all_days"))


@query("j17_reconciliation", _SIGNED + ", a as (select ticker, sum(s) as p from signed where ord % 3 <> 0 group by ticker), b as (select ticker, sum(s) as p from signed where ord % 5 <> 0 group by ticker) select coalesce(a.ticker, b.ticker) as ticker, coalesce(a.p, 0) as internal, coalesce(b.p, 0) as actual from a full join b on a.ticker = b.ticker where coalesce(a.p, 0) <> coalesce(b.p, 0)")
def _(t):
    signed = t.fills.withColumn("s", F.when(F.col("side") == "buy", F.col("n")).otherwise(-F.col("n")))
    side = lambda d: signed.where(F.col("ord") % d != 0).groupBy("ticker").agg(F.sum("s").alias("position"))
    return fills.reconcile(side(3), side(5))


@query("j18_orphan_orders", "select ord, ticker from fills where ord % 3 <> 0 and ord not in (select ord from fills where ord % 5 <> 0)")
def _(t):
    known = t.fills.where("ord % 5 <> 0").select("ord")
    return t.fills.where("ord % 3 <> 0").join(known, "ord", "left_anti").select("ord", "ticker")


@query("j16_market_enrichment", "select f.ord, f.ticker, m.result, m.c_mktsegment from fills f left join markets m using (ticker)")
def _(t):
    return t.fills.join(t.markets, "ticker", "left").select("ord", "ticker", "result", "c_mktsegment")


@query("p27_cash_events", "select ord as id, ticker, (case when side = 'buy' then -1 else 1 end) * price * n - 1 as cash from fills union all select -f.ord, f.ticker, f.n * 100 from fills f join markets m using (ticker) where m.result = 'yes' and f.side = 'buy'")
def _(t):
    cash = F.when(F.col("side") == "buy", -1).otherwise(1) * F.col("price") * F.col("n") - 1
    paid = t.fills.where("side = 'buy'").join(t.markets.where("result = 'yes'"), "ticker").select((-F.col("ord")).alias("id"), "ticker", (F.col("n") * 100).alias("cash"))
    return t.fills.select(F.col("ord").alias("id"), "ticker", cash.alias("cash")).unionByName(paid)


@query("o03_recent_fills", "select ticker, ord, side, price from fills order by ord desc limit 20")
def _(t):
    return t.fills.orderBy(F.desc("ord")).limit(20).select("ticker", "ord", "side", "price")


@query("a29_sharpe", _TRIPS + "select ticker, count(*) as n, coalesce(round(avg(pnl) / nullif(stddev_samp(pnl), 0), 6), 0) as sharpe from trips group by ticker")
def _(t):
    ratio = F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0))
    return fills.round_trips(t.fills).groupBy("ticker").agg(F.count("*").alias("n"), F.coalesce(F.round(ratio, 6), F.lit(0.0)).alias("sharpe"))


@query("b18_queue_fills", """, orders2 as (select event_id as order_id, ticker, 'buy' as side, 30 + k % 26 as price, ord as placed, ord + 86400000000 as until, k % 3 as queue_ahead, 5 as remaining from ev where event_type = 'view'),
 h as (select o.*, t.ord as at_ord, greatest(t.size - queue_ahead, 0) as avail from orders2 o join trades t on o.ticker = t.ticker and o.price = t.price and t.ord > o.placed and t.ord <= o.until and t.taker = 'no'),
 c as (select *, sum(avail) over (partition by order_id order by at_ord) as cum from h) select order_id, ticker, at_ord as "at", least(remaining, cum) - least(remaining, cum - avail) as filled from c where least(remaining, cum) - least(remaining, cum - avail) > 0""")
def _(t):
    orders = t.ev.where("event_type = 'view'").select(F.col("event_id").alias("order_id"), "ticker", F.lit("buy").alias("side"), (30 + F.col("k") % 26).alias("price"), F.col("ord").alias("placed"), (F.col("ord") + 86400 * SECOND).alias("until"), (F.col("k") % 3).alias("queue_ahead"), F.lit(5).alias("remaining"))
    return fills.queue_fills(orders, t.trades, 86_400 * SECOND)


@query("j23_quote_lineage", _QUOTES + ", o as (select event_id as order_id, ticker, ord as placed from ev where event_type = 'view'), f as (select event_id as fill_id, event_id - 1 as order_id, ticker from ev where event_type = 'purchase'), p as (select f.fill_id, f.order_id, f.ticker, o.placed from f join o on f.order_id = o.order_id) select p.fill_id, p.order_id, p.ticker, p.placed, q.ord as quoted_at, q.bid, q.ask from p asof left join quotes q on p.ticker = q.ticker and p.placed >= q.ord")
def _(t):
    orders = t.ev.where("event_type = 'view'").select(F.col("event_id").alias("order_id"), "ord")
    done = t.ev.where("event_type = 'purchase'").select(F.col("event_id").alias("fill_id"), (F.col("event_id") - 1).alias("order_id"), "ticker")
    return fills.lineage(done, orders, _quotes(t)).select("fill_id", "order_id", "ticker", "placed", F.col("asof_on").alias("quoted_at"), "bid", "ask")


_MIDS = ", latest as (select ticker, arg_max(mid_x2, ord) / 2.0 as mid from books where mid_x2 is not null group by ticker)"
_POSITIONS = _COSTS + _MIDS + f""", lasts as (select ticker, z.q as q, z.c as cost, round_even(abs(z.c) / abs(z.q), 0) as entry from costs where is_last and z.q <> 0),
  open_ as (select p.ticker, cast(q as bigint) as position, cost, cast(entry as bigint) as entry, mid, case when mid is null then 0.0 when q > 0 then (mid - entry) * q else (entry - mid) * -q end as mtm from lasts p left join latest l on l.ticker = 'M' || (p.ticker % 20))"""


def _mids(t):
    """The latest mid of each fill's market, in cents."""
    latest = fills.latest_quotes(book.best(book.valid_books(book.depth(t.frames))).where("mid_x2 is not null"))
    return latest.select(F.col("ticker").alias("market"), (F.col("mid_x2") / 2).alias("mid"))


def _market(rows):
    return rows.withColumn("market", F.concat(F.lit("M"), F.col("ticker") % 20))


@query("a32_mark_to_market", _POSITIONS + "select ticker, position, round(cost, 6) as cost, entry, mid, round(mtm, 6) as mtm from open_")
def _(t):
    marked = fills.marked(_market(fills.open_costs(fills.average_cost(t.fills, width=4096))).join(_mids(t), "market", "left"))
    return marked.select("ticker", "position", F.round("cost", 6).alias("cost"), "entry", "mid", F.round("mtm", 6).alias("mtm"))


@query("a45_portfolio", _POSITIONS + f""", r as (select sum(z.r) / 100 as realized, sum({_FEE.format('price')} * n) / 100.0 as fees from costs), m as (select count(*) as open_tickers, cast(sum(abs(position)) as bigint) as gross, cast(sum(position) as bigint) as net, sum(mtm) as mtm from open_)
  select open_tickers, gross, net, round(realized, 6) as realized, round(fees, 6) as fees, round(mtm, 6) as mtm, round(realized - fees + mtm / 100, 6) as net_pnl from r, m""")
def _(t):
    costs = kept(fills.average_cost(t.fills, width=4096))
    marked = fills.marked(_market(fills.open_costs(costs)).join(_mids(t), "market", "left"))
    return fills.portfolio(costs, marked)


@query("a33_exposure", _OPEN + _MIDS + """, s as (select o.*, m.result, l.mid, case when m.result = 'yes' then 100 - price when m.result = 'no' then -price else l.mid - price end as b from opened o left join markets m using (ticker) left join latest l on l.ticker = 'M' || (o.ticker % 20)),
  p as (select coalesce(result, 'open') as result, coalesce(case when side = 'buy' then b else -b end, 0) as pnl from s) select case when grouping(result) = 0 then result end as result, count(*) as n, round(sum(pnl), 6) as pnl, count(*) filter (pnl > 0) as wins, count(*) filter (pnl < 0) as losses from p group by grouping sets ((result), ())""")
def _(t):
    rows = _market(fills.unpaired(t.fills).join(t.markets.select("ticker", "result"), "ticker", "left")).join(_mids(t), "market", "left")
    buyer = F.when(F.col("result") == "yes", 100 - F.col("price")).when(F.col("result") == "no", -F.col("price")).otherwise(F.col("mid") - F.col("price"))
    pnl = F.coalesce(F.when(F.col("side") == "buy", buyer).otherwise(-buyer), F.lit(0.0))
    done = rows.select(F.coalesce("result", F.lit("open")).alias("result"), pnl.alias("pnl"))
    return done.groupingSets([[F.col("result")], []], "result").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 6).alias("pnl"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"))


@query("a31_settled_pnl", ", c as (select ticker, sum(case when side = 'buy' then price * n else -price * n end) as cost, sum(case when side = 'buy' then n else -n end) as q, sum(" + _FEE.format("price") + " * n) as fee from fills group by ticker), s as (select c.ticker, case when m.result = 'yes' then 100 * q else 0 end - cost - fee as pnl, fee from c join markets m using (ticker) where m.result is not null) select case when grouping(ticker) = 0 then ticker end as ticker, cast(sum(pnl) as bigint) as pnl, cast(sum(fee) as bigint) as fee, count(*) filter (pnl > 0) as wins from s group by grouping sets ((ticker), ())")
def _(t):
    return fills.settled(t.fills, t.markets.where("result is not null")).groupingSets([[F.col("ticker")], []], "ticker").agg(F.sum("pnl").alias("pnl"), F.sum("fee").alias("fee"), F.count_if(F.col("pnl") > 0).alias("wins"))


_EDGES = "case when {0} <= {1} then '<={1}' when {0} <= {2} then '{1}-{2}' when {0} <= {3} then '{2}-{3}' else '>{3}' end"


@query("a25_bucketed_edge", _TRIPS + f""", b as (select pnl, unnest([{{'by': 'price', 'bucket': {_EDGES.format('buy_price', 30, 50, 70)}}}, {{'by': 'spread', 'bucket': {_EDGES.format('abs(sell_price - buy_price)', 2, 5, 10)}}}, {{'by': 'tenth', 'bucket': cast(least(9, (buy_price - 1) // 10) as varchar)}}]) as x from trips)
  select x['by'] as dimension, x['bucket'] as bucket, count(*) as n, round(avg(pnl), 6) as mean_pnl, round(avg(cast(pnl > 0 as int)), 6) as win_rate from b group by all having count(*) >= 5""")
def _(t):
    p, s = F.col("buy_price"), F.abs(F.col("sell_price") - F.col("buy_price"))
    cuts = lambda c, a, b, d: F.when(c <= a, f"<={a}").when(c <= b, f"{a}-{b}").when(c <= d, f"{b}-{d}").otherwise(f">{d}")
    of = lambda name, bucket: F.struct(F.lit(name).alias("dimension"), bucket.alias("bucket"))
    dimensions = [of("price", cuts(p, 30, 50, 70)), of("spread", cuts(s, 2, 5, 10)), of("tenth", F.least(F.lit(9), F.floor((p - 1) / 10)).cast("string"))]
    rows = fills.round_trips(t.fills).select("pnl", F.explode(F.array(*dimensions)).alias("d")).select("pnl", "d.*")
    return rows.groupBy("dimension", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("pnl"), 6).alias("mean_pnl"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("win_rate")).where("n >= 5")
