"""Queries of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.functions import game, money
from ticklake.plans.bridge import query


@query("p01_dollars_to_cents", "select event_id, cast(round_even(value * 100, 0) as int) as cents from events")
def _(t):
    return t("events").select("event_id", money.dollars_to_cents(F.col("value").cast("string")).alias("cents"))


@query("p02_parse_size", "select event_id, cast(round_even(value, 0) as bigint) as size from events")
def _(t):
    return t("events").select("event_id", money.parse_size(F.col("value").cast("string")).alias("size"))


@query("p03_loose_cents", "select event_id, case when value <= 1.0 then cast(round_even(value * 100, 0) as int) else cast(round_even(value, 0) as int) end as cents from events")
def _(t):
    return t("events").select("event_id", money.loose_cents(F.col("value")).alias("cents"))


@query("p04_parse_time", "select event_id, case event_id % 4 when 0 then event_id * 1.0 when 1 then (1700000000000 + event_id) / 1000.0 when 2 then 1704067200.0 end as seconds from events")
def _(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, (F.lit(1700000000000) + F.col("event_id")).cast("string")).when(k == 2, "2024-01-01T00:00:00Z").otherwise("no time")
    return t("events").select("event_id", game.parse_time(text).alias("seconds"))


@query("p09_complement_price", "select ticker, ord, price as yes_price, 100 - price as no_price from trades")
def _(t):
    return t.trades.select("ticker", "ord", F.col("price").alias("yes_price"), (100 - F.col("price")).alias("no_price"))


@query("p10_seconds_to_ns", "select event_id, cast(trunc((event_id * 0.37::double) * 1e9) as bigint) as ns from events")
def _(t):
    return t("events").select("event_id", money.seconds_to_ns(F.col("event_id") * F.lit(0.37)).alias("ns"))


_TICKER = ", tick as (select p_partkey, case p_partkey % 5 when 0 then 'KXNBAGAME-26APR20MINDEN-MIN' when 1 then 'KXNBASPREAD-26APR20MINDEN-DEN' || (p_size % 9 + 1) when 2 then 'KXNBATOTAL-26APR20MINDEN-' || (200 + p_size) when 3 then 'KXNBAPTS-26APR25OKCPHX-PHXDBROOKS3-' || (p_size % 40) else 'SOMETHINGELSE-FOO-BAR' end as tk, p_size from part)"


def _tickers(t):
    s, k = F.col("p_size"), F.col("p_partkey") % 5
    text = (
        F.when(k == 0, "KXNBAGAME-26APR20MINDEN-MIN")
        .when(k == 1, F.concat(F.lit("KXNBASPREAD-26APR20MINDEN-DEN"), s % 9 + 1))
        .when(k == 2, F.concat(F.lit("KXNBATOTAL-26APR20MINDEN-"), 200 + s))
        .when(k == 3, F.concat(F.lit("KXNBAPTS-26APR25OKCPHX-PHXDBROOKS3-"), s % 40))
        .otherwise("SOMETHINGELSE-FOO-BAR")
    )
    return t("part").select("p_partkey", text.alias("tk"))


@query("p12_series", _TICKER + "select p_partkey, case when regexp_extract(tk, '(KXNBA\\w+?)-', 1) = '' then 'unknown' else regexp_extract(tk, '(KXNBA\\w+?)-', 1) end as series from tick")
def _(t):
    return _tickers(t).select("p_partkey", game.series(F.col("tk")).alias("series"))


@query(
    "p13_parse_ticker",
    _TICKER + """select p_partkey, case p_partkey % 5 when 0 then 'GAME' when 1 then 'SPREAD' when 2 then 'TOTAL' when 3 then 'PTS' else 'UNKNOWN' end as series,
    case when p_partkey % 5 = 3 then '2026-04-25' when p_partkey % 5 < 3 then '2026-04-20' end as game_date, case when p_partkey % 5 = 3 then 'OKC' when p_partkey % 5 < 3 then 'MIN' end as away,
    case when p_partkey % 5 = 3 then 'PHX' when p_partkey % 5 < 3 then 'DEN' end as home, case p_partkey % 5 when 0 then 'MIN' when 1 then 'DEN' when 3 then 'PHXDBROOKS3' end as selection,
    case p_partkey % 5 when 1 then p_size % 9 + 1 when 2 then 200 + p_size when 3 then p_size % 40 end as threshold from tick""",
)
def _(t):
    return _tickers(t).select("p_partkey", game.parse_ticker(F.col("tk")).alias("p")).select("p_partkey", "p.series", F.col("p.game_date").cast("string").alias("game_date"), "p.away", "p.home", "p.selection", "p.threshold")


@query("p14_player_parts", _TICKER + "select p_partkey, case when p_partkey % 5 = 3 then '26APR25OKCPHX' end as game, case when p_partkey % 5 = 3 then 'PHX' end as team, case when p_partkey % 5 = 3 then 'DBROOKS3' end as player, case when p_partkey % 5 = 3 then p_size % 40 end as threshold from tick")
def _(t):
    return _tickers(t).select("p_partkey", game.player_parts(F.col("tk")).alias("p")).select("p_partkey", "p.*")


@query("p15_player_key", _TICKER + "select p_partkey, case when p_partkey % 5 = 3 then 'PHXDBROOKS3' else tk end as player from tick")
def _(t):
    return _tickers(t).select("p_partkey", game.player_key(F.col("tk")).alias("player"))


@query("p16_game_teams", _TICKER + "select p_partkey, substr(split_part(tk, '-', 2), 8, 3) as away, substr(split_part(tk, '-', 2), 11, 3) as home from tick")
def _(t):
    key = F.get(F.split("tk", "-"), F.lit(1))
    away, home = game.game_teams(key)
    return _tickers(t).select("p_partkey", away.alias("away"), home.alias("home"))


@query("p17_clock_seconds", "select o_orderkey, case when 1 + o_orderkey % 5 <= 4 then (o_orderkey % 12) * 60 + o_orderkey % 60 + (4 - (1 + o_orderkey % 5)) * 720 else (o_orderkey % 12) * 60 + o_orderkey % 60 end * 1.0 as seconds from orders")
def _(t):
    o = F.col("o_orderkey")
    clock = F.concat(F.lit("PT"), F.lpad((o % 12).cast("string"), 2, "0"), F.lit("M"), F.lpad((o % 60).cast("string"), 2, "0"), F.lit(".00S"))
    return t("orders").select("o_orderkey", game.clock_seconds(1 + o % 5, clock).alias("seconds"))


Z = "(lead + 3.5 * secs / 2880) / sqrt(0.44 * secs)"
#: Phi by its series, nested from the last of 60 terms; right to about 1e-15 for z within 5.
PHI = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * z * list_reduce(list_prepend(1.0::double, list_transform(range(121, 1, -2), lambda k: k * 1.0::double)), lambda s, k: 1 + z * z / k * s)"
#: The model's chance from z, lead and secs.
CHANCE = f"case when secs <= 0 then case when lead > 0 then 1.0 when lead < 0 then 0.0 else 0.5 end when z > 5 then 1.0 when z < -5 then 0.0 else {PHI} end"
GAME_STATES = "states0 as (select o_orderkey, o_orderkey % 21 - 10 as lead, (o_orderkey % 2880) * 1.0::double as secs from orders)"


_P18 = f", {GAME_STATES}, zs as (select *, case when secs > 0 then {Z} end as z from states0) select o_orderkey, round({CHANCE}, 6) as p from zs"


@query("p18_win_probability", _P18)
def _(t):
    o = F.col("o_orderkey")
    return t("orders").select("o_orderkey", F.round(game.win_probability(o % 21 - 10, (o % 2880).cast("double")), 6).alias("p"))


@query("p19_fees", "select ticker, ord, round(0.07 * (price / 100.0) * (1 - price / 100.0), 9) as taker, round(0.25 * 0.07 * (price / 100.0) * (1 - price / 100.0), 9) as maker, greatest(1, cast(floor(0.0175 * price * (100 - price) / 100) as int)) as maker_cents, greatest(1, cast(floor(0.0287 * price * (100 - price) / 100) as int)) as taker_cents from trades")
def _(t):
    d = F.col("price") / 100
    return t.trades.select("ticker", "ord", F.round(money.taker_fee(d), 9).alias("taker"), F.round(money.maker_fee(d), 9).alias("maker"), money.maker_fee_cents(F.col("price")).alias("maker_cents"), money.taker_fee_cents(F.col("price")).alias("taker_cents"))


@query("p20_entry_fees", ", f as (select ticker, ord, price / 100.0 as a, (100 - price) / 100.0 as b from trades) select ticker, ord, round(0.25 * 0.07 * a * (1 - a) + 0.07 * b * (1 - b), 9) as fees from f")
def _(t):
    return t.trades.select("ticker", "ord", F.round(money.entry_fees(F.col("price") / 100, (100 - F.col("price")) / 100, 1), 9).alias("fees"))


@query("p21_imbalance", ", s as (select ticker, epoch, sum(qty) filter (side = 'yes') as y, sum(qty) filter (side = 'no') as n from seeds group by all) select ticker, epoch, round((y - n) / (y + n + 1), 9) as imbalance from s")
def _(t):
    from ticklake.operators import book

    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")))
    rows = book.seeds(t.frames).groupBy("ticker", "epoch").agg(side("yes").alias("y"), side("no").alias("n"))
    return rows.select("ticker", "epoch", F.round(money.imbalance(F.col("y"), F.col("n")), 9).alias("imbalance"))


@query("p22_top_bid_size", "select ticker, epoch, arg_max(qty, price) filter (side = 'yes') as size, arg_max(qty, price) filter (side = 'no') as no_size from seeds group by all")
def _(t):
    return t.frames.where("kind = 'snapshot'").select("ticker", F.col("ord").alias("epoch"), money.top_size(F.col("levels"), "yes").alias("size"), money.top_size(F.col("levels"), "no").alias("no_size"))


@query("p23_hour", "select event_id, ord // 3600000000 % 24 as hour from ev")
def _(t):
    return t.ev.select("event_id", F.expr("ord div 3600000000 % 24").alias("hour"))


@query("p24_edge", "select ticker, ord, round(case when user_id % 2 = 0 then 0.6 else 0.4 end - price / 100.0, 9) as edge from trades")
def _(t):
    return t.trades.select("ticker", "ord", F.round(money.edge(F.lit(0.6), F.col("price"), F.col("user_id") % 2 == 0), 9).alias("edge"))


@query("p25_market_metadata", "select c_custkey as ticker, trim(c_mktsegment) as series_ticker, c_name as title, coalesce(case c_custkey % 3 when 0 then 'yes' when 1 then 'no' end, '') as result, cast(round_even(c_acctbal, 0) as bigint) as volume, case when c_acctbal / 10000 <= 1.0 then cast(round_even(c_acctbal / 10000 * 100, 0) as int) else cast(round_even(c_acctbal / 10000, 0) as int) end as last_price_cents from customer")
def _(t):
    from ticklake.sources.markets import normalize

    raw = t("customer").select(
        F.col("c_custkey").alias("ticker"), F.trim("c_mktsegment").alias("series_ticker"), F.col("c_name").alias("title"),
        F.when(F.col("c_custkey") % 3 == 0, "yes").when(F.col("c_custkey") % 3 == 1, "no").alias("result"), F.col("c_acctbal").cast("string").alias("volume"), (F.col("c_acctbal") / 10000).alias("last_price"),
    )
    return normalize(raw).select("ticker", "series_ticker", "title", "result", "volume", "last_price_cents")


@query("p26_minutes_since_first", "select ticker, ord, round((ord - min(ord) over (partition by ticker)) / 60e6, 6) as minutes from trades")
def _(t):
    from pyspark.sql import Window

    return t.trades.select("ticker", "ord", F.round((F.col("ord") - F.min("ord").over(Window.partitionBy("ticker"))) / 60e6, 6).alias("minutes"))


@query("p05_p08_flat_frames", "select ticker, ord, 'delta' as kind, side, price / 100.0 as price, delta * 1.0 as amount from deltas union all select ticker, ord, 'trade', taker, price / 100.0, size * 1.0 from trades")
def _(t):
    from ticklake.sources import frames

    parsed = frames.parse(archive_lines(t))
    flat = frames.flat_deltas(parsed).select("ticker", "seq", F.lit("delta").alias("kind"), "side", "price", F.col("delta").alias("amount"))
    both = flat.unionByName(frames.flat_trades(parsed).select("ticker", "seq", F.lit("trade").alias("kind"), F.col("taker").alias("side"), "price", F.col("size").alias("amount")))
    return both.withColumnRenamed("seq", "ord")


def archive_lines(t):
    """All deltas and trades as JSON lines of the archive (column ``value``); ``seq`` is the rows' ord."""
    d = t.deltas.select("ticker", "ord", "side", (F.col("price") / 100).cast("string").alias("p"), F.col("delta").cast("string").alias("q"), F.lit("orderbook_delta").alias("type"))
    r = t.trades.select("ticker", "ord", F.col("taker").alias("side"), (F.col("price") / 100).cast("string").alias("p"), F.col("size").cast("string").alias("q"), F.lit("trade").alias("type"))
    msg = F.struct(F.col("ticker").alias("market_ticker"), F.when(F.col("type") == "trade", F.col("p")).alias("yes_price_dollars"), F.when(F.col("type") == "trade", F.col("q")).alias("count_fp"), F.when(F.col("type") == "trade", F.col("side")).alias("taker_side"), F.when(F.col("type") != "trade", F.col("p")).alias("price_dollars"), F.when(F.col("type") != "trade", F.col("q")).alias("delta_fp"), F.when(F.col("type") != "trade", F.col("side")).alias("side"))
    text = F.to_json(F.struct(F.lit("x").alias("source"), F.col("type").alias("channel"), (F.col("ord") / 1e6).alias("t_receipt"), F.struct("type", F.col("ord").alias("seq"), msg.alias("msg")).alias("frame")))
    return d.unionByName(r).select(text.alias("value"))


def _parsed(rows, kind, msg):
    """Frames of one kind as the archive has them, through JSON text: ``seq`` is the rows' ord."""
    from ticklake.sources import frames

    text = F.to_json(F.struct(F.lit("x").alias("source"), F.lit(kind).alias("channel"), (F.col("ord") / 1e6).alias("t_receipt"), F.struct(F.lit(kind).alias("type"), F.col("ord").alias("seq"), F.struct(*msg).alias("msg")).alias("frame")))
    return frames.parse(rows.select(text.alias("value")))


@query(
    "p06_flat_snapshots",
    """select ticker, epoch as ord, round(max(price) filter (side = 'yes') / 100.0, 6) as best_bid, round(1 - max(price) filter (side = 'no') / 100.0, 6) as best_ask,
    round(1 - max(price) filter (side = 'no') / 100.0 - max(price) filter (side = 'yes') / 100.0, 6) as spread, sum(qty) filter (side = 'yes') as yes_depth, sum(qty) filter (side = 'no') as no_depth,
    count(*) filter (side = 'yes') as yes_levels, count(*) filter (side = 'no') as no_levels from seeds group by ticker, epoch""",
)
def _(t):
    from ticklake.sources import frames

    own = lambda s: F.transform(F.filter("levels", lambda x: x["side"] == s), lambda x: F.array((x["price"] / 100).cast("string"), x["qty"].cast("string"))).alias(f"{s}_dollars_fp")
    flat = frames.flat_snapshots(_parsed(t.frames.where("kind = 'snapshot'"), "orderbook_snapshot", [F.col("ticker").alias("market_ticker"), own("yes"), own("no")]))
    rounded = [F.round(c, 6).alias(c) for c in ("best_bid", "best_ask", "spread")]
    return flat.select("ticker", F.col("seq").alias("ord"), *rounded, "yes_depth", "no_depth", F.col("yes_levels").cast("bigint").alias("yes_levels"), F.col("no_levels").cast("bigint").alias("no_levels"))


@query("p08_trade_events", "select ticker as market_ticker, ord as seq, taker as side, price, size from trades where size > 1")
def _(t):
    from ticklake.sources import frames

    rows = t.trades.withColumn("taker", F.when(F.col("size") > 1, F.col("taker")).otherwise(""))  # an empty taker makes no trade
    msg = [F.col("ticker").alias("market_ticker"), (F.col("price") / 100).cast("string").alias("yes_price_dollars"), F.col("size").cast("string").alias("count_fp"), F.col("taker").alias("taker_side")]
    return frames.trade_events(_parsed(rows, "trade", msg)).select("market_ticker", "seq", "side", "price", "size")


@query("p28_private_fills", "select 'fill' as kind, 'T' || ticker as ticker, 'o' || ord as order_id, 'yes' as side, side as action, price, n as count, cast(null as varchar) as status, cast(null as bigint) as position from fills")
def _(t):
    from ticklake.sources import frames

    msg = [F.concat(F.lit("T"), "ticker").alias("market_ticker"), F.concat(F.lit("o"), "ord").alias("order_id"), F.lit("yes").alias("side"), F.col("side").alias("action"), (F.col("price") / 100).cast("string").alias("yes_price_dollars"), F.col("n").cast("string").alias("count_fp")]
    return frames.private_events(_parsed(t.fills, "fill", msg)).drop("t_receipt")
