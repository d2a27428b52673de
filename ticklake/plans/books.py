"""Order-book queries over the frames made of ``events``."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import functions as F

from ticklake.functions import money
from ticklake.operators import book
from ticklake.operators.kept import folder, kept
from ticklake.operators.quantiles import quantiles
from ticklake.plans.bridge import BASE, query
from ticklake.sources import sinks

DAY_US = 86_400_000_000


@query("b01_snapshot_seed", "select ticker, epoch, side, price, qty from seeds")
def _(t):
    return book.seeds(t.frames)


@query("b02_epochs", "select ticker, ord, epoch, epoch_sid from epochs")
def _(t):
    return book.with_epoch(t.frames).where("kind = 'delta'").select("ticker", "ord", "epoch", "epoch_sid")


@query("f02_f03_dropped_deltas", "select ticker, ord, case when epoch is null then 'no_snapshot' else 'other_subscription' end as reason from epochs where epoch is null or sid <> epoch_sid")
def _(t):
    return book.stale_deltas(t.frames).select("ticker", "ord", "reason")


@query("b03_level_state", "select ticker, epoch, ord, side, price, change, qty from levels")
def _(t):
    return book.level_state(t.frames)


@query(
    "b04_level_state_min_size",
    """, steps as (select ticker, epoch, side, price, list(ord order by ord, change) as ords, list(cast(change as bigint) order by ord, change) as cs from changes group by all),
    placed as (select ticker, epoch, side, price, ords, cs, unnest(range(1, len(ords) + 1)) as i from steps)
    select ticker, epoch, side, price, ords[i] as ord, cs[i] as change, list_reduce(list_prepend(0::bigint, cs[1:i]), lambda q, c: case when q + c >= 15 then q + c else 0 end) as qty from placed""",
)
def _(t):
    return book.level_state_min_size(t.frames, 15)


@query("b05_bbo", "select * from allbooks")
def _(t):
    return book.best(book.depth(t.frames))


@query("b06_cross_invalidation", "select ticker, epoch, ord from firstcross")
def _(t):
    return book.crosses(book.depth(t.frames))


@query("b06_valid_bbo", "select * from books")
def _(t):
    return book.best(book.valid_books(book.depth(t.frames)))


@query(
    "b07_connection_losses",
    """, starts as (select conn, min(ord) as begins from ev group by conn), nexts as (select conn, lead(begins) over (order by begins) as lost_at from starts)
    select distinct s.ticker, s.conn, n.lost_at from snapshots s join nexts n using (conn) where lost_at is not null""",
)
def _(t):
    return book.connection_losses(t.frames)


_LEVELS = ", ".join(
    [f"max(price) filter (side = 'yes' and k = {k}) as bid_{k}, max(qty) filter (side = 'yes' and k = {k}) as bid_{k}_size" for k in range(1, 11)]
    + [f"100 - max(price) filter (side = 'no' and k = {k}) as ask_{k}, max(qty) filter (side = 'no' and k = {k}) as ask_{k}_size" for k in range(1, 11)]
    + [f"coalesce(sum(qty) filter (side = '{s}' and price >= top - {c}), 0) as {name}_depth_{c}c" for s, name in (("yes", "bid"), ("no", "ask")) for c in (5, 10)]
    + ["count(*) filter (side = 'yes') as num_bid_levels", "count(*) filter (side = 'no') as num_ask_levels"]
)

_ZEROS = ", ".join(f"coalesce({c}, 0) as {c}" for c in (*(f"{n}_depth_{c}c" for n in ("bid", "ask") for c in (5, 10)), "num_bid_levels", "num_ask_levels"))


@query(
    "b08_depth",
    f""", ranked as (
      select *, row_number() over (partition by ticker, epoch, ord, side order by price desc) as k, max(price) over (partition by ticker, epoch, ord, side) as top from resting
    ), wide as (select ticker, epoch, ord, {_LEVELS} from ranked group by all)
    select b.ticker, b.epoch, b.ord, w.* exclude (ticker, epoch, ord, bid_depth_5c, ask_depth_5c, bid_depth_10c, ask_depth_10c, num_bid_levels, num_ask_levels), {_ZEROS}, b.spread, b.mid_x2
    from allbooks b left join wide w on b.ticker = w.ticker and b.epoch = w.epoch and b.ord = w.ord""",
)
def _(t):
    return book.depth(t.frames)


@query(
    "b09_level_listing",
    "select ticker, epoch, ord, side, string_agg(price || ':' || qty, ' ' order by price desc) as levels, count(*) as n from resting where ord = epoch group by all",
)
def _(t):
    rows = book.seeds(t.frames)
    listed = rows.groupBy("ticker", "epoch", "side").agg(F.reverse(F.array_sort(F.collect_list(F.struct("price", "qty")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["price"].cast("string"), x["qty"].cast("string"))), " ")
    return listed.select("ticker", "epoch", F.col("epoch").alias("ord"), "side", text.alias("levels"), F.size("l").cast("bigint").alias("n"))


@query("b10_lob_history", "select ticker, ord as ts, side, price, qty from resting")
def _(t):
    return book.history(t.frames).select("ticker", F.col("ord").alias("ts"), "side", "price", "qty")


@query("b11_snapshot_windows", "select ticker, ord, lead(ord) over (partition by ticker order by ord) as until from snapshots")
def _(t):
    return book.windows(t.frames.where("kind = 'snapshot'")).select("ticker", "ord", "until")


_DRIFT = """, pairs as (
  select * from (select ticker, conn, ord as epoch, lead(ord) over (partition by ticker, conn order by ord) as next_epoch from snapshots) where next_epoch is not null
), worked as (select distinct ticker, epoch from live), used as (select p.* from pairs p join worked w on w.ticker = p.ticker and w.epoch = p.epoch),
finals as (select ticker, epoch, side, price, max_by(qty, ord) as rebuilt from levels group by all having max_by(qty, ord) > 0),
a as (select u.ticker, u.epoch, u.next_epoch, f.side, f.price, f.rebuilt from used u join finals f on f.ticker = u.ticker and f.epoch = u.epoch),
b as (select u.ticker, u.epoch, u.next_epoch, s.side, s.price, s.qty as snapshot from used u join seeds s on s.ticker = u.ticker and s.epoch = u.next_epoch),
drift as (select coalesce(a.ticker, b.ticker) as ticker, coalesce(a.epoch, b.epoch) as epoch, coalesce(a.next_epoch, b.next_epoch) as next_epoch, coalesce(a.side, b.side) as side, coalesce(a.price, b.price) as price,
  coalesce(rebuilt, 0) as rebuilt, coalesce(snapshot, 0) as snapshot from a full join b on a.ticker = b.ticker and a.epoch = b.epoch and a.next_epoch = b.next_epoch and a.side = b.side and a.price = b.price)
"""


@query("b12_boundary_drift", _DRIFT + "select * from drift where rebuilt <> snapshot")
def _(t):
    return book.boundary_drift(t.frames)


@query("b13_drift_metric", _DRIFT + "select ticker, sum(abs(rebuilt - snapshot)) as drift, count(*) as wrong_levels, count(distinct epoch) as boundaries from drift where rebuilt <> snapshot group by ticker")
def _(t):
    rows = book.boundary_drift(t.frames)
    return rows.groupBy("ticker").agg(F.sum(F.abs(F.col("rebuilt") - F.col("snapshot"))).alias("drift"), F.count("*").alias("wrong_levels"), F.countDistinct("epoch").alias("boundaries"))


#: Snapshots with the next one of their connection, and how far the last levels of a table are from what that opens with.
_PAIRS = ", prs as (select * from (select ticker, conn, ord as epoch, lead(ord) over (partition by ticker, conn order by ord) as next_epoch from snapshots) where next_epoch is not null)"


def _apart(name: str, lasts: str, pairs: str = "prs") -> str:
    return f""", {name}x as (select p.ticker, p.epoch, f.side, f.price, f.qty as d from {pairs} p join ({lasts}) f on f.ticker = p.ticker and f.epoch = p.epoch union all select p.ticker, p.epoch, s.side, s.price, -s.qty from {pairs} p join seeds s on s.ticker = p.ticker and s.epoch = p.next_epoch),
  {name}y as (select ticker, epoch, side, price, abs(sum(d)) as d from {name}x group by all), {name} as (select p.ticker, p.epoch, coalesce(sum(d), 0)::bigint as drift, count(*) filter (d > 0) as wrong from {pairs} p left join {name}y y on y.ticker = p.ticker and y.epoch = p.epoch group by p.ticker, p.epoch)"""


_WITH = """, tl as (select t.ticker, s.ord as epoch, t.ord, case when taker = 'yes' then 'no' else 'yes' end as side, case when taker = 'yes' then 100 - price else price end as price, -size as change from trades t asof join snapshots s on t.ticker = s.ticker and t.conn = s.conn and t.ord >= s.ord where t.sid = s.sid),
  ch2 as (select ticker, epoch, ord, side, price, change from changes union all select * from tl), su2 as (select *, sum(change) over (partition by ticker, epoch, side, price order by ord) as total from ch2),
  le2 as (select ticker, epoch, ord, side, price, total - least(0, min(total) over (partition by ticker, epoch, side, price order by ord)) as qty from su2)"""
_LASTS = "select ticker, epoch, side, price, max_by(qty, ord) as qty from {0} group by all"


@query("b13_drift_with_trades", _PAIRS + _WITH + _apart("da", _LASTS.format("levels")) + _apart("db", _LASTS.format("le2")) + """ select a.ticker, count(*) as boundaries, round(avg(a.drift), 6) as mean_without, max(a.drift) as most_without, sum(a.wrong)::bigint as wrong_without, round(avg(b.drift), 6) as mean_with, max(b.drift) as most_with, sum(b.wrong)::bigint as wrong_with,
  count(*) filter (b.drift < a.drift) as with_less, count(*) filter (a.drift < b.drift) as without_less, count(*) filter (a.drift = b.drift) as level from da a join db b using (ticker, epoch) group by a.ticker""")
def _(t):
    return book.drift_with_trades(t.frames, t.trades)


@query(
    "b14_sampled_book",
    """, seqs as (select ticker, epoch, list([ord] order by ord) as os from allbooks group by all),
    chosen as (select ticker, epoch, unnest(list_reduce(os, lambda acc, x: case when x[1] - acc[-1] >= 3600000000 then list_append(acc, x[1]) else acc end)) as ord from seqs)
    select b.* from allbooks b join chosen c on c.ticker = b.ticker and c.epoch = b.epoch and c.ord = b.ord""",
)
def _(t):
    return book.best(book.sampled(book.depth(t.frames), DAY_US // 24))


#: A day in the middle of the table, within a connection.
_MIDDLE = ", dd as (select (min(day) + max(day)) // 2 // 5 * 5 + 2 as d from ev)"


@query("b15_cross_midnight_seed", "select * from allbooks where ord >= epoch and ord // 86400000000 > epoch // 86400000000")
def _(t):
    rows = book.best(book.depth(t.frames))
    return rows.where(F.floor(F.col("ord") / DAY_US) > F.floor(F.col("epoch") / DAY_US))


@query("b15_built_date", _MIDDLE + """, tc as (select arg_min(conn, ord) as conn from deltas, dd where day = d), lost as (select ticker, epoch from (select ticker, epoch, arg_max(spread, ord) as s from allbooks, dd where ord // 86400000000 < d and epoch // 86400000000 = d - 1 group by all) where s < 0),
  own as (select s.ticker, s.ord as epoch from snapshots s, dd, tc where s.ord // 86400000000 = d or (s.ord // 86400000000 = d - 1 and s.conn = tc.conn))
  select b.* from books b join own o on o.ticker = b.ticker and o.epoch = b.epoch, dd where b.ord // 86400000000 = d and not exists (select 1 from lost l where l.ticker = b.ticker and l.epoch = b.epoch)""")
def _(t):
    first, last = t.ev.agg(F.min("day"), F.max("day")).first()
    d = (first + last) // 2 // 5 * 5 + 2
    root, near = folder(t.spark, "frames"), t.frames.where(F.col("day").between(d - 3, d + 1))  # days of an archive of frames
    near.withColumn("dt", F.concat(F.lit("d"), "day")).drop("day").write.partitionBy("dt").parquet(root)
    return book.best(book.build_date(t.spark.read.parquet(root), f"d{d}", f"d{d - 1}"))


@query("d01_book_violations", "select ticker, ord, 'crossed' as check, cast(spread as varchar) as detail from allbooks where spread <= 0")
def _(t):
    return book.violations(book.depth(t.frames))


@query(
    "d03_depth_gate",
    "select count(*) as n_rows, count(spread) as n_spreads, count(*) filter (spread < 0) as n_crossed, count(*) filter (spread < 0) * 20 <= count(spread) as crossed_ok, true as sizes_ok, (select count(*) from trades) as trades_in, (select count(*) from trades where size > 1) as trades_out, (select count(*) from trades where size <= 1) = 0 as trades_ok from books",
)
def _(t):
    from ticklake.operators import quality

    return quality.depth_gate(book.valid_books(book.depth(t.frames)), t.trades, t.trades.where("size > 1"))


@query("d06_first_cross_context", ", n as (select *, row_number() over (partition by ticker, epoch order by ord) as rn from allbooks), c as (select n.ticker, n.epoch, n.rn from n join firstcross f on f.ticker = n.ticker and f.epoch = n.epoch and f.ord = n.ord) select n.ticker, n.epoch, n.ord, n.rn - c.rn as offset_rows, n.spread from n join c on c.ticker = n.ticker and c.epoch = n.epoch where n.rn - c.rn between -5 and 10")
def _(t):
    from pyspark.sql import Window

    rows = book.best(book.depth(t.frames)).withColumn("rn", F.row_number().over(Window.partitionBy("ticker", "epoch").orderBy("ord")))
    cross = book.crosses(rows).join(rows.select("ticker", "epoch", "ord", F.col("rn").alias("at")), ["ticker", "epoch", "ord"]).drop("ord")
    near = rows.join(cross, ["ticker", "epoch"]).withColumn("offset_rows", F.col("rn") - F.col("at"))
    return near.where("offset_rows between -5 and 10").select("ticker", "epoch", "ord", "offset_rows", "spread")


_FEES = "greatest(1, cast(floor({0} * bid * (100 - bid) / 100) as int)) + greatest(1, cast(floor({0} * ask * (100 - ask) / 100) as int))"


@query("a12_spread_stats", f"select ticker, count(*) as n, median(spread) as median_spread, round(avg(spread), 6) as mean_spread, round(avg(cast(spread > {_FEES.format('0.0175')} as int)), 6) as profitable, round(avg(cast(spread > {_FEES.format('0.0287')} as int)), 6) as profitable_as_taker from books where spread > 0 group by ticker")
def _(t):
    rows = book.best(book.valid_books(book.depth(t.frames))).where("spread > 0")
    share = lambda fee: F.round(F.avg((F.col("spread") > fee(F.col("bid")) + fee(F.col("ask"))).cast("int")), 6)
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.median("spread").alias("median_spread"), F.round(F.avg("spread"), 6).alias("mean_spread"), share(money.maker_fee_cents).alias("profitable"), share(money.taker_fee_cents).alias("profitable_as_taker"))


@query("a37_crossed_rate", "select case when grouping(kind) = 0 then kind end as kind, case when grouping(ticker) = 0 then ticker end as ticker, count(spread) as n, count(*) filter (spread < 0) as crossed, round(avg(case when spread < 0 then 1.0 when spread >= 0 then 0.0 end), 6) as crossed_rate from (select *, case when ord = epoch then 'snapshot' else 'delta' end as kind from allbooks) group by grouping sets ((kind), (ticker))")
def _(t):
    rows = book.depth(t.frames).select("ticker", F.when(F.col("ord") == F.col("epoch"), "snapshot").otherwise("delta").alias("kind"), "spread")
    sets = rows.groupingSets([[F.col("kind")], [F.col("ticker")]], "kind", "ticker")
    return sets.agg(F.count("spread").alias("n"), F.count_if(F.col("spread") < 0).alias("crossed"), F.round(F.avg((F.col("spread") < 0).cast("double")), 6).alias("crossed_rate"))


@query("a46_rebuilt_spreads", "select case when grouping(kind) = 0 then kind end as kind, count(spread) as n, round(avg(spread), 6) as mean_spread, median(spread) as median_spread, min(spread) as least, max(spread) as most, round(avg(cast(spread < 0 as int)), 6) as share_negative, round(avg(cast(spread = 1 as int)), 6) as share_one_cent from (select *, case when ord = epoch then 'subscribed' else 'continuous' end as kind from allbooks) group by grouping sets ((kind), ())")
def _(t):
    rows, s = kept(book.depth(t.frames).select(F.when(F.col("ord") == F.col("epoch"), "subscribed").otherwise("continuous").alias("kind"), "spread")), F.col("spread")
    shares = [F.round(F.avg(c.cast("int")), 6).alias(n) for c, n in ((s < 0, "share_negative"), (s == 1, "share_one_cent"))]
    out = None
    for kind in ("subscribed", "continuous", None):  # the book as a snapshot gives it, as deltas make it, and both
        own = rows.where(F.col("kind") == kind) if kind else rows
        stats = own.agg(F.count(s).alias("n"), F.round(F.avg(s), 6).alias("mean_spread"), F.lit(quantiles(own, "spread", [0.5])[0]).cast("double").alias("median_spread"), F.min(s).alias("least"), F.max(s).alias("most"), *shares).select(F.lit(kind).cast("string").alias("kind"), "*")
        out = stats if out is None else out.unionByName(stats)
    return out


@query("f06_extreme_price", "select p.low, p.high, count(*) as n from books b, (values (10, 90), (42, 58), (46, 54), (10, 55), (46, 90), (45, 60)) p(low, high) where bid <= low or ask >= high group by all")
def _(t):
    bounds = t.spark.createDataFrame([(10, 90), (42, 58), (46, 54), (10, 55), (46, 90), (45, 60)], "low int, high int")  # alike on both sides, and not
    rows = book.best(book.valid_books(book.depth(t.frames)))
    return rows.crossJoin(F.broadcast(bounds)).where("bid <= low or ask >= high").groupBy("low", "high").agg(F.count("*").alias("n"))


@query("f07_valid_spread", "select ticker, count(*) as n from books where spread > 0 group by ticker")
def _(t):
    return book.valid_books(book.depth(t.frames)).where("spread > 0").groupBy("ticker").agg(F.count("*").alias("n"))


@query("k09_bbo_view", "select ticker as market_ticker, ord as t_receipt_ns, bid as bid_1, bid_size as bid_1_size, ask as ask_1, ask_size as ask_1_size, spread from books where bid_size >= 50 and ask_size >= 50")
def _(t):
    root, name = folder(t.spark, "OrderBookDepth"), f"depth_{uuid4().hex}"
    sinks.write_events(book.valid_books(book.depth(t.frames)).withColumnsRenamed({"ticker": "market_ticker", "ord": "t_receipt_ns"}), root, "2026-01-01")
    sinks.read_events(t.spark, root, "2026-01-01").createOrReplaceTempView(name)
    sinks.bbo_view(t.spark, f"{name}_bbo", name)
    return t.spark.table(f"{name}_bbo").drop("date", "v")


@query("w08_bbo_changes", ", two as (select * from books where bid is not null and ask is not null), x as (select *, row(bid, ask) is distinct from lag(row(bid, ask)) over (partition by ticker, epoch order by ord) as changed from two) select ticker, epoch, ord, bid, ask from x where changed")
def _(t):
    from ticklake.operators import fills

    return fills.quote_changes(book.best(book.valid_books(book.depth(t.frames)))).select("ticker", "epoch", "ord", "bid", "ask")


@query("st07_latest_book", ", x as (select *, row_number() over (partition by ticker order by ord desc) as rn from books) select ticker, ord, bid, ask, bid_size, ask_size from x where rn = 1")
def _(t):
    rows = book.best(book.valid_books(book.depth(t.frames)))
    return rows.groupBy("ticker").agg(F.max_by(F.struct("ord", "bid", "ask", "bid_size", "ask_size"), "ord").alias("b")).select("ticker", "b.*")


@query("st06_need_snapshot", "select ticker, ord from epochs where epoch is null union all select l.ticker, l.ord from live l join firstcross f on f.ticker = l.ticker and f.epoch = l.epoch where l.ord > f.ord")
def _(t):
    lost = book.stale_deltas(t.frames).where("reason = 'no_snapshot'").select("ticker", "ord")
    first = book.crosses(book.depth(t.frames)).withColumnRenamed("ord", "cross_at")
    after = book.live_deltas(t.frames).join(first, ["ticker", "epoch"]).where("ord > cross_at").select("ticker", "ord")
    return lost.unionByName(after)


def _chain(suffix: str, changes: str) -> str:
    """The base tables from changes to books once more, for changes of another rule."""
    text = BASE[BASE.index("), sums as (") + 3 : BASE.index("), firstcross as (")]
    names = ("changes", "sums", "levels", "states", "moments", "resting", "bests", "allbooks")
    return f", {names[0]}{suffix} as ({changes}), " + re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: m[1] + suffix, text) + ")"


_SEEDED = "select ticker, epoch, epoch as ord, side, price, qty as change from seeds union all select ticker, {0} as epoch, ord, side, price, delta from {1}"
_FOREIGN = """, fo as (select e.ticker, e.epoch, e.ord, e.side, e.price, e.delta, 1 + cast(seq * 7919 % 10 < 6 as int) as own from epochs e where epoch is not null),
  fr as (select *, coalesce(max(case when own <> prev then ord end) over (partition by ticker, epoch order by ord rows between unbounded preceding and current row), epoch) as start, cast(own <> 1 as int) as f from (select *, lag(own, 1, 1) over (partition by ticker, epoch order by ord) as prev from fo)),
  fc as (select *, sum(f) over (partition by ticker, epoch order by ord rows between 4 preceding and current row) as run from fr), c1 as (select ticker, epoch, min(ord) as at1 from fc where f = 1 group by all), c5 as (select ticker, epoch, min(ord) as at5 from fc where run = 5 group by all),
  la as (select * from fr where f = 0), lb as (select r.* from fr r left join c1 using (ticker, epoch) where at1 is null or r.ord < at1), lc as (select r.* from la r left join c5 using (ticker, epoch) where at5 is null or r.ord < at5)"""
_REPAIR = _PAIRS + _FOREIGN + _chain("_a", _SEEDED.format("epoch", "la")) + _chain("_b", _SEEDED.format("epoch", "lb")) + _chain("_c", _SEEDED.format("epoch", "lc")) + _chain("_d", _SEEDED.format("start", "fr"))
_REPAIR += ", pb as (select p.* from prs p left join c1 using (ticker, epoch) where at1 is null), pc as (select p.* from prs p left join c5 using (ticker, epoch) where at5 is null), ns as (select ticker, epoch as opened, max(start) as epoch from fr group by all), nall as (select ticker, ord as opened, coalesce(ns.epoch, s.ord) as epoch from snapshots s left join ns on ns.ticker = s.ticker and ns.opened = s.ord)".replace("select ticker, ord as opened, coalesce", "select s.ticker, s.ord as opened, coalesce")
_REPAIR += _apart("ra", _LASTS.format("levels_a")) + _apart("rb", _LASTS.format("levels_b"), "pb") + _apart("rc", _LASTS.format("levels_c"), "pc")
_REPAIR += _apart("rd", "select l.ticker, n.opened as epoch, l.side, l.price, max_by(l.qty, l.ord) as qty from levels_d l join nall n on n.ticker = l.ticker and n.epoch = l.epoch group by all")
_REPAIR += ", rr as (" + " union all ".join(f"select '{name}' as rule, b.*, coalesce(boundaries, 0) as boundaries, coalesce(drift, 0)::bigint as drift, coalesce(wrong, 0)::bigint as wrong from (select ticker, count(*) as n_rows, count(spread) as n_spreads, count(*) filter (spread < 0) as n_crossed from allbooks_{k} group by ticker) b left join (select ticker, count(*) as boundaries, sum(drift) as drift, sum(wrong) as wrong from r{k} group by ticker) using (ticker)" for name, k in (("standard", "a"), ("first_foreign", "b"), ("fifth_skipped", "c"), ("restarted", "d"))) + ")"


def _foreign(t):
    own = F.when(F.col("kind") == "snapshot", 1).otherwise(1 + (F.col("seq") * 7919 % 10 < 6).cast("int")).cast("bigint")
    return t.frames.withColumn("sid", own)


@query("b16_alternative_repair", _REPAIR + " select * from rr")
def _(t):
    return book.repair_report(_foreign(t), {"standard": None, "first_foreign": (1, False), "fifth_skipped": (5, False), "restarted": (1, True)})


@query("b16_restarted_books", _REPAIR + " select * from allbooks_d")
def _(t):
    return book.best(book.fold_changes(_foreign(t), book.repaired(_foreign(t), 1, True)))


@query("d02_invariants_hold", "select count(*) as n_rows, count(spread) as n_spreads, count(*) filter (spread < 0) as n_crossed, 0 as n_negative, 0 as n_outside from allbooks")
def _(t):
    watched, watch = book.observed(book.depth(t.frames))
    watched.write.parquet(folder(t.spark, "depth"))  # one evaluation, which writes and counts
    found = watch.get
    book.check_metrics(found)
    names = ("n_rows", "n_spreads", "n_crossed", "n_negative", "n_outside")
    return t.spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@query("d03_gated_write", "select ticker as market_ticker, count(*) as n_rows, count(spread) as n_spreads from books group by ticker")
def _(t):
    root, books = folder(t.spark, "gated"), book.valid_books(book.depth(t.frames)).withColumnRenamed("ticker", "market_ticker")
    roots = {"depth": f"{root}/OrderBookDepth", "trades": f"{root}/TradeEvent"}
    events = t.trades.select(F.col("ticker").alias("market_ticker"), "ord", "price", "size", "taker")
    sinks.write_gated(books, events, t.frames.where("kind = 'trade'"), roots, "2026-01-01", folder(t.spark, "staging"))
    return sinks.read_events(t.spark, roots["depth"], "2026-01-01").groupBy("market_ticker").agg(F.count("*").alias("n_rows"), F.count("spread").alias("n_spreads"))


@query("d07_freshness")
def _(t):
    from ticklake.operators import quality

    return quality.freshness(t("events"))
