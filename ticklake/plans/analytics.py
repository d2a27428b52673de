"""Queries across markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.operators import book, cross, tape
from ticklake.operators.joins import asof_nearest
from ticklake.operators.kept import kept
from ticklake.operators.quantiles import quantiles
from ticklake.plans.bridge import query

HOUR = 3_600_000_000
#: Markets M0 to M9 are games; M10 to M19 the spreads of the same games.
_LEGS = ", legs as (select *, 'G' || (user_id % 10) as game, case when user_id % 20 < 10 then 'game' else 'spread' end as leg from trades)"
_NEAR = _LEGS + f""", near as (select a.game, a.ord, a.price as game_price, b.ord as asof_on, b.price as spread_price, row_number() over (partition by a.game, a.ord order by abs(b.ord - a.ord), b.ord) as rn
  from legs a join legs b on a.game = b.game and a.leg = 'game' and b.leg = 'spread' and abs(a.ord - b.ord) <= {HOUR}), matched as (select game, ord, game_price, asof_on, spread_price from near where rn = 1)"""


def _legs(t):
    leg = F.when(F.col("user_id") % 20 < 10, "game").otherwise("spread")
    return t.trades.withColumn("game", F.concat(F.lit("G"), F.col("user_id") % 10)).withColumn("leg", leg)


def _matched(t):
    legs = _legs(t)
    left = legs.where("leg = 'game'").select("game", "ord", F.col("price").alias("game_price"))
    right = legs.where("leg = 'spread'").select("game", "ord", F.col("price").alias("spread_price"))
    return asof_nearest(left, right, ["game"], "ord", "ord", ["spread_price"], F.lit(HOUR), width=24 * HOUR).where("asof_on is not null")


@query("j02_nearest_books", _NEAR + "select * from matched")
def _(t):
    return _matched(t)


@query("j11_pair_discovery", _LEGS + "select a.ticker as game_ticker, b.ticker as spread_ticker from (select distinct game, ticker from legs where leg = 'game') a join (select distinct game, ticker from legs where leg = 'spread') b using (game)")
def _(t):
    legs = _legs(t)
    side = lambda s: legs.where(F.col("leg") == s).select("game", F.col("ticker").alias(f"{s}_ticker")).distinct()
    return side("game").join(side("spread"), "game").select("game_ticker", "spread_ticker")


@query("j13_outcomes", _LEGS + "select l.game, count(*) as n, max(o.result) as result from legs l left join (select 'G' || (ticker % 10) as game, arg_max(result, ticker) as result from markets where result is not null group by all) o using (game) group by l.game")
def _(t):
    outcome = t.markets.where("result is not null").groupBy(F.concat(F.lit("G"), F.col("ticker") % 10).alias("game")).agg(F.max_by("result", "ticker").alias("result"))
    return _legs(t).join(outcome, "game", "left").groupBy("game").agg(F.count("*").alias("n"), F.max("result").alias("result"))


_TAKER, _MAKER = "0.07 * ({0} / 100.0) * (1 - {0} / 100.0)", "0.0175 * ({0} / 100.0) * (1 - {0} / 100.0)"
_PAIR_FEE = lambda g, s: f"({_MAKER.format(g)} + {_TAKER.format(s)})"
#: Entries of the first gap over a least one, the games' outcomes, and both together at settlement.
_ENTRIES = """, en as (select game, min(ord) as ord, arg_min(game_price, ord) as game_price, arg_min(spread_price, ord) as spread_price from matched where abs(game_price - spread_price) > {0} group by game),
  oc as (select 'G' || (ticker % 10) as game, arg_max(result, ticker) = 'yes' as won, 1 + max(ticker) % 3 as margin from markets where result is not null group by all),
  st as (select en.*, game_price - spread_price as gap, won, margin, case when game_price > spread_price then 'sell_game' else 'buy_game' end as direction, case when not won then 'loses' when margin = 1 then 'wins_by_one' else 'wins_by_two' end as outcome,
    cast(won as int) as game_leg, cast(won and margin >= 2 as int) as spread_leg, """ + _PAIR_FEE("game_price", "spread_price") + """ as fee,
    abs(game_price - spread_price) / 100.0 + case when won and margin = 1 then case when game_price > spread_price then -1 else 1 end else 0 end - """ + _PAIR_FEE("game_price", "spread_price") + """ as pnl from en join oc using (game))"""


def _outcomes(t):
    game = F.concat(F.lit("G"), F.col("ticker") % 10).alias("game")
    return t.markets.where("result is not null").groupBy(game).agg((F.max_by("result", "ticker") == "yes").alias("won"), (1 + F.max("ticker") % 3).alias("margin"))


_DIV = _LEGS + f""", lp as (select game, leg, ord // {6 * HOUR} as bin, arg_max(price, ord) as price from legs group by all), sp as (select game, leg, unnest(range(min(bin), max(bin) + 1)) as bin from lp group by game, leg),
 fl as (select s.game, s.leg, s.bin, last_value(l.price ignore nulls) over w as price, s.bin - max(case when l.price is not null then s.bin end) over w as stale from sp s left join lp l on l.game = s.game and l.leg = s.leg and l.bin = s.bin window w as (partition by s.game, s.leg order by s.bin rows between unbounded preceding and current row)),
 dv as (select a.game, a.bin, a.price - b.price as divergence, greatest(a.stale, b.stale) as stale from fl a join fl b on a.game = b.game and a.bin = b.bin and a.leg = 'game' and b.leg = 'spread')"""


@query("x02_divergence", _DIV + "select * from dv where stale <= 10")
def _(t):
    return cross.divergence(_legs(t), 6 * HOUR, 10)


_QUOTED = f""", lq as (select *, 'G' || (cast(substr(ticker, 2) as int) % 10) as game, cast(substr(ticker, 2) as int) < 10 as is_game from books where bid is not null and ask is not null),
  nq as (select a.game, a.ord, a.bid as gb, a.ask as ga, a.bid_size as gbs, a.ask_size as gas, b.bid as sb, b.ask as sa, b.bid_size as sbs, b.ask_size as sas, row_number() over (partition by a.game, a.ord order by abs(b.ord - a.ord), b.ord) as rn from lq a join lq b on a.game = b.game and a.is_game and not b.is_game and abs(a.ord - b.ord) <= {HOUR}),
  ex as (select game, ord, (ga + gb - sa - sb) / 2.0 as d, greatest(gb - sa, sb - ga) as x, case when gb - sa >= sb - ga then least(gbs, sas) else least(sbs, gas) end as depth, ga - gb as game_cost, sa - sb as spread_cost from nq where rn = 1)"""


@query("a42_divergence_stats", _QUOTED + """select count(*) as n, round(avg(d), 6) as mean, median(d) as median_d, round(stddev_samp(d), 6) as deviation, round(avg(x), 6) as mean_x, median(x) as median_x, round(stddev_samp(x), 6) as deviation_x,
  round(avg(cast(d > 3 as int)), 6) as over_3, round(avg(cast(d > 5 as int)), 6) as over_5, round(avg(cast(d > 10 as int)), 6) as over_10, round(avg(cast(x > 3 as int)), 6) as x_over_3, round(avg(cast(x > 5 as int)), 6) as x_over_5, round(avg(cast(x > 10 as int)), 6) as x_over_10,
  median(game_cost + spread_cost) as crossing, round(avg(game_cost), 6) as game_cost, round(avg(spread_cost), 6) as spread_cost, median(depth) filter (x > 3) as depth_over_3, round(avg(cast(depth < 50 as int)) filter (x > 3), 6) as thin_over_3 from ex""")
def _(t):
    number = F.substring("ticker", 2, 9).cast("int")
    quotes = book.best(book.valid_books(book.depth(t.frames))).where("bid is not null and ask is not null").withColumn("game", F.concat(F.lit("G"), number % 10))
    side = lambda own, name: quotes.where(own).select("game", "ord", *[F.col(c).alias(f"{name}_{c}") for c in ("bid", "ask", "bid_size", "ask_size")])
    values = [f"spread_{c}" for c in ("bid", "ask", "bid_size", "ask_size")]
    near = asof_nearest(side(number < 10, "game"), side(number >= 10, "spread"), ["game"], "ord", "ord", values, F.lit(HOUR), width=24 * HOUR).where("asof_on is not null")
    return cross.divergence_stats(near)


@query("x03_executable_divergence", _NEAR + "select game, ord, greatest(game_price - (spread_price + 2), spread_price - (game_price + 2)) as best, case when game_price - (spread_price + 2) >= spread_price - (game_price + 2) then 'sell_game' else 'sell_spread' end as direction from matched")
def _(t):
    quoted = _matched(t).select("game", "ord", F.col("game_price").alias("game_bid"), (F.col("game_price") + 2).alias("game_ask"), F.col("spread_price").alias("spread_bid"), (F.col("spread_price") + 2).alias("spread_ask"))
    return cross.executable(quoted).select("game", "ord", "best", "direction")


@query("x04_pair_pnl", _NEAR + _ENTRIES.format(10) + "select game, ord, gap, direction, outcome, margin, game_leg, spread_leg, round(fee, 9) as fee, round(pnl, 9) as pnl from st")
def _(t):
    rows = cross.settled_pairs(cross.pair_entries(_matched(t), 10), _outcomes(t))
    return rows.select("game", "ord", "gap", "direction", "outcome", "margin", "game_leg", "spread_leg", F.round("fee", 9).alias("fee"), F.round("pnl", 9).alias("pnl"))


@query("a38_outcome_breakdown", _NEAR + _ENTRIES.format(10) + """select case when grouping(outcome) = 0 then outcome end as outcome, case when grouping(direction) = 0 then direction end as direction, count(*) as n, round(avg(pnl), 9) as mean_pnl, round(sum(pnl), 9) as total_pnl, round(avg(cast(pnl > 0 as int)), 9) as win_rate, count(*) filter (outcome = 'wins_by_one') as one_point,
  round((avg(cast(outcome = 'wins_by_one' as int)) + avg(fee) * (1 - avg(cast(outcome = 'wins_by_one' as int)))) / case when avg(cast(outcome = 'wins_by_one' as int)) < 0.5 then 1 - 2 * avg(cast(outcome = 'wins_by_one' as int)) end, 9) as break_even from st group by grouping sets ((outcome), (direction), ())""")
def _(t):
    rows, pnl = cross.settled_pairs(cross.pair_entries(_matched(t), 10), _outcomes(t)), F.col("pnl")
    one = F.col("outcome") == "wins_by_one"
    p = F.avg(one.cast("int"))
    needed = (p + F.avg("fee") * (1 - p)) / F.when(p < 0.5, 1 - 2 * p)  # in dollars of divergence
    sets = rows.groupingSets([[F.col("outcome")], [F.col("direction")], []], "outcome", "direction")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg(pnl), 9).alias("mean_pnl"), F.round(F.sum(pnl), 9).alias("total_pnl"), F.round(F.avg((pnl > 0).cast("int")), 9).alias("win_rate"), F.count_if(one).alias("one_point"), F.round(needed, 9).alias("break_even"))


@query("a43_exit_breakdown", _NEAR + _ENTRIES.format(10) + """, xs as (select en.*, en.game_price - en.spread_price as gap, level, min(m.ord) as exit, arg_min(m.game_price, m.ord) as exit_game, arg_min(m.spread_price, m.ord) as exit_spread from en cross join (values (1), (2), (5)) v(level) left join matched m on m.game = en.game and m.ord > en.ord and abs(m.game_price - m.spread_price) < level group by all),
  cv as (select x.game, level, x.gap as gap, case when exit is null then 'settlement' else 'converged' end as kind, (exit - x.ord) / 60e6 as hold, exit_game - exit_spread as exit_gap, s.pnl as settled,
    case when exit is null then """ + _PAIR_FEE("x.game_price", "x.spread_price") + " else " + _PAIR_FEE("x.game_price", "x.spread_price") + " + " + _PAIR_FEE("exit_game", "exit_spread") + """ end as fee,
    case when exit is null then s.pnl else (case when x.gap > 0 then x.gap - (exit_game - exit_spread) else (exit_game - exit_spread) - x.gap end) / 100.0 - """ + _PAIR_FEE("x.game_price", "x.spread_price") + " - " + _PAIR_FEE("exit_game", "exit_spread") + """ end as pnl from xs x left join st s using (game))
  select level, kind, count(*) as n, round(avg(cast(pnl > 0 as int)), 9) as win_rate, round(avg(pnl), 9) as mean_pnl, round(sum(pnl), 9) as total_pnl, round(avg(fee), 9) as mean_fee, round(quantile_cont(hold, 0.25), 9) as hold_p25, round(median(hold), 9) as hold, round(quantile_cont(hold, 0.75), 9) as hold_p75, round(avg(abs(gap)), 9) as entry_size, round(avg(abs(exit_gap)), 9) as exit_size,
    round(avg(settled), 9) as mean_settled, round(sum(settled), 9) as total_settled, round(avg(pnl) / nullif(stddev_samp(pnl), 0), 9) as sharpe from cv where kind = 'converged' or settled is not null group by level, kind""")
def _(t):
    rows, outcomes = kept(_matched(t)), _outcomes(t)
    entries, parts = cross.pair_entries(rows, 10), None
    for level in (1, 2, 5):
        own = cross.converged_pairs(entries, rows, outcomes, level).withColumn("level", F.lit(level))
        parts = own if parts is None else parts.unionByName(own)
    pnl, at = F.col("pnl"), lambda q: F.round(F.percentile("hold", F.lit(q)), 9)  # a row per game
    return parts.groupBy("level", "kind").agg(
        F.count("*").alias("n"), F.round(F.avg((pnl > 0).cast("int")), 9).alias("win_rate"), F.round(F.avg(pnl), 9).alias("mean_pnl"), F.round(F.sum(pnl), 9).alias("total_pnl"), F.round(F.avg("fee"), 9).alias("mean_fee"), at(0.25).alias("hold_p25"), at(0.5).alias("hold"), at(0.75).alias("hold_p75"),
        F.round(F.avg(F.abs("gap")), 9).alias("entry_size"), F.round(F.avg(F.abs("exit_gap")), 9).alias("exit_size"), F.round(F.avg("settled"), 9).alias("mean_settled"), F.round(F.sum("settled"), 9).alias("total_settled"), F.round(F.avg(pnl) / F.nullif(F.stddev_samp(pnl), F.lit(0.0)), 9).alias("sharpe"),
    )


@query("x12_maker_feasibility", """select ticker, count(*) as n, median(spread) as median_spread, round(avg(cast(spread / 2.0 > greatest(1, cast(floor(0.0175 * bid * (100 - bid) / 100) as int)) as int)), 6) as feasible_maker, round(avg(cast(spread / 2.0 > greatest(1, cast(floor(0.0287 * bid * (100 - bid) / 100) as int)) as int)), 6) as feasible_taker,
  round(avg(cast(spread > greatest(1, cast(floor(0.0175 * bid * (100 - bid) / 100) as int)) + greatest(1, cast(floor(0.0175 * ask * (100 - ask) / 100) as int)) as int)), 6) as round_trip_maker, round(avg(cast(spread > greatest(1, cast(floor(0.0287 * bid * (100 - bid) / 100) as int)) + greatest(1, cast(floor(0.0287 * ask * (100 - ask) / 100) as int)) as int)), 6) as round_trip_taker from books where spread > 0 group by ticker""")
def _(t):
    from ticklake.functions.money import maker_fee_cents, taker_fee_cents

    rows, s = book.best(book.valid_books(book.depth(t.frames))).where("spread > 0"), F.col("spread")
    whole = lambda fee: tape.share(s > fee(F.col("bid")) + fee(F.col("ask")))
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.median("spread").alias("median_spread"), tape.share(s / 2 > maker_fee_cents(F.col("bid"))).alias("feasible_maker"), tape.share(s / 2 > taker_fee_cents(F.col("bid"))).alias("feasible_taker"), whole(maker_fee_cents).alias("round_trip_maker"), whole(taker_fee_cents).alias("round_trip_taker"))


_TAPES = """, live_q as (select ticker, ord, price, size from trades where ord % 2 = 0), replay_q as (select ticker, ord + 7 as ord, price, size from trades where ord % 3 <> 0), times as (select ticker, ord from live_q union select ticker, ord from replay_q),
  a1 as (select t.ticker, t.ord, case when l.ord is not null then {'price': l.price, 'size': l.size} end as live from times t asof left join live_q l on l.ticker = t.ticker and t.ord >= l.ord),
  a2 as (select a1.*, case when r.ord is not null then {'price': r.price, 'size': r.size} end as replay from a1 asof left join replay_q r on r.ticker = a1.ticker and a1.ord >= r.ord),
  ends as (select *, lead(ord) over (partition by ticker order by ord) as until from a2) """


@query("j24_tape_diff", _TAPES + "select ticker, ord, live.price as live_price, live.size as live_size, replay.price as replay_price, replay.size as replay_size, until from ends where live is distinct from replay")
def _(t):
    live = t.trades.where("ord % 2 = 0")
    replay = t.trades.where("ord % 3 <> 0").withColumn("ord", F.col("ord") + 7)
    found = cross.tape_diff(live, replay, ["price", "size"], 24 * HOUR)
    return found.select("ticker", "ord", F.col("live.price").alias("live_price"), F.col("live.size").alias("live_size"), F.col("replay.price").alias("replay_price"), F.col("replay.size").alias("replay_size"), "until")
