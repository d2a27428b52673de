"""Queries on win probabilities: scoring, calibration and profit by threshold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklake.functions.game import win_probability
from ticklake.operators import book, model
from ticklake.operators.joins import asof
from ticklake.plans.bridge import query
from ticklake.plans.scalars import CHANCE, Z

DAY = 86_400_000_000
#: Scored trades: a made-up probability and outcome per trade, the same on both sides.
_SCORED = ", scored as (select ticker, ord, price, taker, (k2 % 101) / 100.0 as p, price / 100.0 as m, case when k2 % 100 < price then 1 else 0 end as won, k2 % 2880 as secs from (select *, (ord // 1000000 * 7 + size * 13) % 9973 as k2 from trades))"


def _scored(t):
    k2 = F.expr("(ord div 1000000 * 7 + size * 13) % 9973")
    return t.trades.withColumn("k2", k2).select("ticker", "ord", "price", "taker", ((F.col("k2") % 101) / 100).alias("p"), (F.col("price") / 100).alias("m"), (F.col("k2") % 100 < F.col("price")).cast("int").alias("won"), (F.col("k2") % 2880).alias("secs"))


@query("j01_align_trades", ", snaps as (select ticker, ord, k from snapshots) select t.ticker, t.ord, s.ord as asof_on, s.k from trades t asof left join snaps s on t.ticker = s.ticker and t.ord >= s.ord")
def _(t):
    states = t.ev.where("event_type = 'signup'").select("ticker", "ord", "k")
    return asof(t.trades.select("ticker", "ord"), states, ["ticker"], "ord", "ord", ["k"], width=DAY)


@query("x05_scored_trades", f""", st as (select ticker, ord, k % 21 - 10 as lead, (k * 29 % 2880) * 1.0::double as secs from ev where event_type = 'signup'),
  al as (select t.ticker, t.ord, t.price, t.user_id, s.ord as asof_on, s.lead, s.secs from trades t asof join st s on t.ticker = s.ticker and t.ord >= s.ord), zs as (select *, case when secs > 0 then {Z} end as z from al where secs <= 2400),
  ps as (select *, {CHANCE} as p0 from zs) select ticker, ord, price, user_id, asof_on, lead, cast(secs as int) as secs, round(p0, 6) as p, round(case when user_id % 2 = 0 then p0 else 1 - p0 end - price / 100.0, 6) as edge from ps""")
def _(t):
    states = t.ev.where("event_type = 'signup'").select("ticker", "ord", (F.col("k") % 21 - 10).alias("lead"), (F.col("k") * 29 % 2880).alias("secs"))
    aligned = asof(t.trades.select("ticker", "ord", "price", "user_id"), states, ["ticker"], "ord", "ord", ["lead", "secs"], width=DAY).where("asof_on is not null and secs <= 2400")
    scored = model.score(aligned, F.col("user_id") % 2 == 0)
    return scored.withColumns({"p": F.round("p", 6), "edge": F.round("edge", 6)})


@query("a17_brier", _SCORED + "select count(*) as n, round(avg(pow(p - won, 2)), 6) as model, round(avg(pow(m - won, 2)), 6) as market from scored")
def _(t):
    return model.brier(_scored(t), [])


@query("a18_brier_slices", _SCORED + "select case when secs < 300 then 300 when secs < 720 then 720 when secs < 1440 then 1440 else 2880 end as cut, count(*) as n, round(avg(pow(p - won, 2)), 6) as model, round(avg(pow(m - won, 2)), 6) as market from scored group by all")
def _(t):
    s = F.col("secs")
    cut = F.when(s < 300, 300).when(s < 720, 720).when(s < 1440, 1440).otherwise(2880)
    return model.brier(_scored(t).withColumn("cut", cut), ["cut"])


_GAMES = _SCORED + ", games as (select ticker as game, count(*) as n, round(avg(pow(p - won, 2)), 10) as model, round(avg(pow(m - won, 2)), 10) as market from scored group by ticker)"


@query("a18_brier_games", _GAMES + "select *, case when model < market then 'model' when model > market then 'market' else 'level' end as better from games")
def _(t):
    return model.with_better(model.brier(_scored(t), [F.col("ticker").alias("game")], 10))


@query("a18_win_tally", _GAMES + "select case when model < market then 'model' when model > market then 'market' else 'level' end as better, count(*) as games, sum(n)::bigint as trades from games group by all")
def _(t):
    games = model.with_better(model.brier(_scored(t), [F.col("ticker").alias("game")], 10))
    return games.groupBy("better").agg(F.count("*").alias("games"), F.sum("n").alias("trades"))


_CAL = _SCORED + ", cal as (select least(len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: e <= p)), 9) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(won), 6) as rate from scored group by all)"


@query("a19_calibration", _CAL + "select * from cal")
def _(t):
    return model.calibration(_scored(t), 10)


@query("a20_calibration_error", _CAL + "select round(sum(n * abs(mean_p - rate)) / sum(n), 6) as ece from cal")
def _(t):
    return model.calibration_error(model.calibration(_scored(t), 10))


@query("a21_threshold_pnl", _SCORED + """, v as (select *, threshold from scored, (values (0.0), (0.05), (0.1), (0.2)) x(threshold)),
  b as (select *, case when p - m > threshold then won - m when p - m < -threshold then m - won end as pnl from v) select threshold, count(pnl) as n, round(coalesce(sum(pnl), 0), 6) as pnl, count(*) filter (pnl > 0) as wins, round(avg(abs(p - m)) filter (pnl is not null), 6) as mean_edge from b group by threshold""")
def _(t):
    return model.threshold_pnl(_scored(t), [0.0, 0.05, 0.1, 0.2])


@query("a22_edge_bins", _SCORED + """, d as (select p - m as e, unnest([{'by': 'time', 'bin': secs // 300}, {'by': 'lead', 'bin': abs(ord // 1000000 % 31 - 15) // 3}, {'by': 'period', 'bin': 4 - least(3, secs // 720)}]) as x from scored) select x['by'] as dimension, x['bin'] as bin, count(*) as n, round(avg(e), 6) as mean_edge, round(stddev_pop(e), 6) as deviation from d group by all""")
def _(t):
    rows = _scored(t).withColumn("lead", F.expr("ord div 1000000 % 31 - 15"))
    return model.edge_by(rows, {"time": F.expr("secs div 300"), "lead": F.expr("abs(lead) div 3"), "period": F.expr("4 - least(3, secs div 720)")})


@query("a23_hit_rate", _SCORED + "select case when p > m then 'bullish' else 'bearish' end as view, count(*) as n, round(avg(won), 6) as rate, round(avg(p), 6) as model, round(avg(m), 6) as market from scored where p <> m group by all")
def _(t):
    view = F.when(F.col("p") > F.col("m"), "bullish").otherwise("bearish")
    return _scored(t).where("p <> m").groupBy(view.alias("view")).agg(F.count("*").alias("n"), F.round(F.avg("won"), 6).alias("rate"), F.round(F.avg("p"), 6).alias("model"), F.round(F.avg("m"), 6).alias("market"))


@query("a44_residuals", _CAL.replace("cal as", "cal0 as") + ", r as (select least(len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: e <= p)), 9) as bin, won - p as residual, p - m as gap from scored) select bin, round(quantile_cont(residual, 0.25), 6) as q1, round(quantile_cont(residual, 0.5), 6) as q2, round(quantile_cont(residual, 0.75), 6) as q3, round(avg(gap), 6) as gap, round(stddev_pop(gap), 6) as gap_deviation from r group by bin")
def _(t):
    rows = _scored(t).select(model.equal_bin(F.col("p"), 10).alias("bin"), (F.col("won") - F.col("p")).alias("residual"), (F.col("p") - F.col("m")).alias("gap"))
    q = [F.round(F.percentile("residual", F.lit(x)), 6).alias(n) for x, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return rows.groupBy("bin").agg(*q, F.round(F.avg("gap"), 6).alias("gap"), F.round(F.stddev_pop("gap"), 6).alias("gap_deviation"))


@query("j22_parameter_sweep", _SCORED + "select threshold, cap, count(*) filter (abs(p - m) > threshold and secs <= cap) as n from scored, (values (0.05), (0.1)) a(threshold), (values (600), (2400)) b(cap) group by all")
def _(t):
    a = F.explode(F.array(F.lit(0.05), F.lit(0.1))).alias("threshold")
    b = F.explode(F.array(F.lit(600), F.lit(2400))).alias("cap")
    params = t.spark.range(1).select(a).select("threshold", b)
    return _scored(t).crossJoin(F.broadcast(params)).groupBy("threshold", "cap").agg(F.count_if((F.abs(F.col("p") - F.col("m")) > F.col("threshold")) & (F.col("secs") <= F.col("cap"))).alias("n"))


@query("f08_time_filter", _SCORED + "select ticker, count(*) as n from scored where secs <= 2400 group by ticker")
def _(t):
    return _scored(t).where("secs <= 2400").groupBy("ticker").agg(F.count("*").alias("n"))


@query("f09_game_eligibility", "select o_custkey as game, count(*) as n from orders group by all having count(*) >= 10 and arg_max(o_orderstatus, o_orderkey) = 'F'")
def _(t):
    return t("orders").groupBy(F.col("o_custkey").alias("game")).agg(F.count("*").alias("n"), F.max_by("o_orderstatus", "o_orderkey").alias("last")).where("n >= 10 and last = 'F'").select("game", "n")


_SC = ", sc as (select ticker, ord, size % 9 as diff, lag(size % 9) over (partition by ticker order by ord) as before, lag(ord) over (partition by ticker order by ord) as before_ord from trades), changes0 as (select ticker, ord, diff, before, before_ord from sc where before is not null and diff <> before)"


@query("w05_score_changes", _SC + "select * from changes0")
def _(t):
    return model.score_changes(t.trades.select("ticker", "ord", (F.col("size") % 9).alias("diff")))


_AROUND = _SC + f""", ra as (select ticker, ord, price, row_number() over (partition by ticker order by ord, price) as rn from trades),
  two as (select c.*, max(t.rn) filter (t.ord < c.ord) as rb, min(t.rn) filter (t.ord > c.ord) as rf from changes0 c join ra t on t.ticker = c.ticker and t.ord > c.ord - {DAY} and t.ord < c.ord + {DAY} group by all having max(t.rn) filter (t.ord < c.ord) is not null and min(t.rn) filter (t.ord > c.ord) is not null),
  re as (select two.*, b.price as price_before, f.price as price_after, (select min_by(m.ord, m.rn) from ra m where m.ticker = two.ticker and m.rn between rf and rf + 49 and abs(m.price - b.price) >= 2) as moved_at from two join ra b on b.ticker = two.ticker and b.rn = rb join ra f on f.ticker = two.ticker and f.rn = rf)"""


def _changes(t):
    return model.score_changes(t.trades.select("ticker", "ord", (F.col("size") % 9).alias("diff")))


@query("j10_around_events", _SC + f"select c.ticker, c.ord, count(*) filter (t.ord < c.ord) as n_before, count(*) filter (t.ord > c.ord) as n_after, arg_max(t.price, t.ord) filter (t.ord < c.ord) as price_before, arg_min(t.price, t.ord) filter (t.ord > c.ord) as price_after from changes0 c join trades t on t.ticker = c.ticker and t.ord between c.ord - {DAY} and c.ord + {DAY} and t.ord <> c.ord group by all")
def _(t):
    return model.around(_changes(t).select("ticker", "ord"), t.trades, DAY)


@query("j10_first_moves", _AROUND + "select ticker, ord, price_before, price_after, moved_at - ord as reaction from re")
def _(t):
    return model.reactions(_changes(t).select("ticker", "ord"), t.trades, DAY).select("ticker", "ord", "price_before", "price_after", (F.col("moved_at") - F.col("ord")).alias("reaction"))


@query("x06_information_delay", _AROUND + f""", w as (select c.ticker, c.ord, sign(diff - before) as way, count(t.ord) as n, arg_max(t.price, t.ord) - arg_min(t.price, t.ord) as move from changes0 c left join trades t on t.ticker = c.ticker and t.ord > c.ord - {2 * DAY} and t.ord < c.ord - {DAY // 5} group by all),
  x as (select c.ord - c.before_ord as detection, re.moved_at - re.ord as reaction, re.ord is not null as around, coalesce(w.n >= 2 and abs(w.move) >= 2 and sign(w.move) = w.way, false) as ahead from changes0 c join w on w.ticker = c.ticker and w.ord = c.ord left join re on re.ticker = c.ticker and re.ord = c.ord)
  select count(*) as n, count(*) filter (around) as n_around, count(reaction) as n_reactions, round(avg(reaction), 3) as mean_reaction, median(reaction) as median_reaction, min(reaction) as least_reaction, max(reaction) as most_reaction, round(avg(detection), 3) as mean_detection, count(*) filter (ahead) as ahead, round(count(*) filter (ahead) / count(*), 6) as ahead_rate from x""")
def _(t):
    return model.information_delay(_changes(t), t.trades, DAY, 2 * DAY, DAY // 5)


_LAGS = "(select a.ticker, h, a.ord, b.price - a.price as ds, (b.ord - a.ord) / 1e6 as dt, row_number() over (partition by a.ticker, a.ord, h order by b.ord) as rn from trades a, (values (86400::bigint), (172800::bigint)) v(h), trades b where b.ticker = a.ticker and abs((b.ord - a.ord) - h * 1000000) * 10 < h * 1000000)"


@query("j21_horizon_pairs", f", g as {_LAGS} select ticker, h, ord, ds, dt from g where rn = 1")
def _(t):
    return model.horizon_pairs(t.trades, [86_400, 172_800], 1_000_000)


@query("j21_row_pairs", f", ra as (select ticker, ord, price, row_number() over (partition by ticker order by ord, price) as rn from trades), g as (select a.ticker, a.ord, b.price - a.price as ds, b.ord - a.ord as dt, row_number() over (partition by a.ticker, a.rn order by b.rn) as k from ra a join ra b on b.ticker = a.ticker and b.rn between a.rn + 1 and a.rn + 19 and b.ord - a.ord > {DAY} and b.ord - a.ord < {3 * DAY} where (a.rn - 1) % 5 = 0) select ticker, ord, ds, dt from g where k = 1")
def _(t):
    return model.row_pairs(t.trades, DAY, 3 * DAY, 19, 5, DAY)


@query("a24_variance_rate", f", g as {_LAGS} select h, count(*) as n, round(var_pop(ds) / avg(dt), 9) as rate from g where rn = 1 group by h")
def _(t):
    pairs = model.horizon_pairs(t.trades, [86_400, 172_800], 1_000_000)
    return pairs.groupBy("h").agg(F.count("*").alias("n"), F.round(F.var_pop("ds") / F.avg("dt"), 9).alias("rate"))


_RATE = f", g as {_LAGS}, r as (select avg(v) as rate from (select var_pop(ds) / avg(dt) as v from g where rn = 1 group by h))"
#: Chances of states under a variance rate, in the columns lead, secs and rate.
_RATED = "case when secs > 0 then (lead + 3.5 * secs / 2880) / sqrt(rate * secs) end as z"


@query("x07_reliability", _SCORED + _RATE + f""", zs as (select won, m, lead, secs, {_RATED} from (select won, m, (ord // 1000000 % 31 - 15) as lead, secs * 1.0::double as secs, r.rate * 1000 as rate from scored, r)), ps as (select won, m, {CHANCE} as p from zs),
  b as (select least(len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: e <= p)), 9) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(won), 6) as rate_won from ps group by all)
  select cast(bin as int) as bin, n, mean_p, rate_won, (select round(rate, 9) from r) as rate, (select round(avg(pow(p - won, 2)), 6) from ps) as brier, (select round(avg(pow(m - won, 2)), 6) from ps) as market_brier from b""")
def _(t):
    pairs = model.horizon_pairs(t.trades, [86_400, 172_800], 1_000_000)
    rate = pairs.groupBy("h").agg((F.var_pop("ds") / F.avg("dt")).alias("v")).agg(F.avg("v").alias("rate"))
    rows = _scored(t).drop("p").withColumn("lead", F.expr("ord div 1000000 % 31 - 15"))
    return model.reliability(rows, rate, 1000)


@query("x08_capped_pnl", _SCORED + """, s as (select *, case when p > m then 1 else -1 end as d from scored where abs(p - m) > 0.1), u as (select *, sum(d) over (partition by ticker order by ord) as after from s),
  m as (select *, coalesce(max(abs(after)) over (partition by ticker order by ord rows between unbounded preceding and 1 preceding), 0) as most from u) select ticker, count(*) as n, round(sum(d * (won - m)), 6) as pnl from m where most < 3 group by ticker""")
def _(t):
    from ticklake.operators.fills import capped

    rows = _scored(t).where("abs(p - m) > 0.1").withColumn("side", F.when(F.col("p") > F.col("m"), "buy").otherwise("sell"))
    d = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return capped(rows, 3).groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.sum(d * (F.col("won") - F.col("m"))), 6).alias("pnl"))


@query("x08_sensitivity", _SCORED + f""", pr as (select * from (values (0.05), (0.1), (0.2)) a(threshold), (values (0.2), (0.44), (0.9)) b(rate), (values (600), (1800), (2880)) c(most_secs), (values (1), (3), (1000000)) d(cap)),
  zs as (select ticker, ord, won, m, lead, secs, rate, {_RATED} from (select ticker, ord, won, m, (ord // 1000000 % 31 - 15) as lead, secs * 1.0::double as secs, rate::double as rate from scored, (select distinct rate from pr))), ps as (select *, {CHANCE} as p from zs),
  s as (select ps.*, threshold, most_secs, cap, case when p > m then 1 else -1 end as d from ps join pr on pr.rate::double = ps.rate where abs(p - m) > threshold and secs <= most_secs),
  u as (select *, sum(d) over (partition by threshold, rate, most_secs, cap, ticker order by ord) as after from s), k as (select *, coalesce(max(abs(after)) over (partition by threshold, rate, most_secs, cap, ticker order by ord rows between unbounded preceding and 1 preceding), 0) as most from u)
  select threshold::double as threshold, rate, most_secs, cap, count(*) as n, round(sum(d * (won - m)), 6) as pnl, round(avg(cast(d * (won - m) > 0 as int)), 6) as win_rate from k where most < cap group by all""")
def _(t):
    rows = _scored(t).drop("p").withColumn("lead", F.expr("ord div 1000000 % 31 - 15"))
    return model.sensitivity(rows, [0.05, 0.1, 0.2], [0.2, 0.44, 0.9], [600, 1800, 2880], [1, 3, 1_000_000], DAY)


@query("j12_match_games", ", g as (select n_nationkey as game, (n_nationkey * 3) % 28 as d, n_name as a, n_regionkey as b from nation), k as (select c_custkey, c_custkey % 28 as d, c_nationkey as n from customer) select k.c_custkey, coalesce(g1.game, g2.game) as game from k left join g g1 on g1.game = k.n and g1.d = k.d left join g g2 on g2.game = k.n and g2.d = k.d - 1 where coalesce(g1.game, g2.game) is not null")
def _(t):
    games = t("nation").select(F.col("n_nationkey").alias("teams"), (F.col("n_nationkey") * 3 % 28).alias("d"), F.col("n_nationkey").alias("game"))
    tickers = t("customer").select("c_custkey", (F.col("c_custkey") % 28).alias("d"), F.col("c_nationkey").alias("teams"))
    return model.match_games(tickers, games).select("c_custkey", "game")


@query("ud01_model_callable", _SCORED + f", zs as (select *, case when secs > 0 then {Z} end as z from (select ticker, ord, won * 4 - 2 as lead, secs * 1.0::double as secs from scored)) select ticker, ord, round({CHANCE}, 6) as p from zs")
def _(t):
    return _scored(t).select("ticker", "ord", F.round(win_probability(F.col("won") * 4 - 2, F.col("secs").cast("double")), 6).alias("p"))


@query("w13_convergence", _SCORED + ", e as (select ticker, min(ord) as entry from scored where abs(p - m) > 0.5 group by ticker), x as (select e.ticker, e.entry, min(s.ord) as out from e left join scored s on s.ticker = e.ticker and s.ord > e.entry and abs(s.p - s.m) < 0.05 group by all) select ticker, entry, out, case when out is null then 'settlement' else 'converged' end as kind from x")
def _(t):
    return model.convergence(_scored(t).withColumn("gap", F.col("p") - F.col("m")), 0.5, 0.05)


#: A position for each trade: with the taker's other side, at its price, closed after so many days or still open.
_HELD = """, quotes0 as (select ticker, ord, mid_x2 / 2.0 as mid from books where mid_x2 is not null), held as (select ticker || '-' || ord as id, ticker, case taker when 'no' then 'long' else 'short' end as side, price as entry, ord as opened, case when size % 3 <> 0 then ord + size * 86400000000 end as closed, 0.05 * (1 + size % 4) as share from trades)"""


def _held(t):
    n = F.col("size")
    return t.trades.select(F.concat_ws("-", "ticker", F.col("ord").cast("string")).alias("id"), "ticker", F.when(F.col("taker") == "no", "long").otherwise("short").alias("side"), F.col("price").alias("entry"), F.col("ord").alias("opened"), F.when(n % 3 != 0, F.col("ord") + n * DAY).alias("closed"), (F.lit(0.05) * (1 + n % 4)).alias("share"))


def _mid_quotes(t):
    return book.best(book.valid_books(book.depth(t.frames))).where("mid_x2 is not null").select("ticker", "ord", (F.col("mid_x2") / 2).alias("mid"))


@query("x09_stop_loss", _HELD + """, hits as (select h.id, min(q.ord) as stop_at, arg_min(q.mid, q.ord) as stop_mid from held h join quotes0 q on q.ticker = h.ticker and q.ord > h.opened and (h.closed is null or q.ord <= h.closed)
  and case when side = 'long' then q.mid <= entry * (1 - share::double) else q.mid >= entry + share::double * (100 - entry) end group by h.id) select h.id, h.ticker, h.side, h.entry, stop_at, stop_mid from held h left join hits using (id)""")
def _(t):
    return model.stop_loss(_held(t), _mid_quotes(t)).select("id", "ticker", "side", "entry", "stop_at", "stop_mid")


@query("x10_flatten_trigger", _HELD + """, z as (select ticker, max(ord) as last from trades group by ticker), hits as (select h.id, min(q.ord) as flat_at from held h join z using (ticker) join quotes0 q on q.ticker = h.ticker and q.ord > h.opened and (h.closed is null or q.ord <= h.closed) and z.last - q.ord <= 432000000000 group by h.id)
  select h.id, h.ticker, flat_at from held h left join hits using (id)""")
def _(t):
    return model.flatten(_held(t), _mid_quotes(t), t.trades, 5 * DAY).select("id", "ticker", "flat_at")


@query("a28_brier_difference")
def _(t):
    from ticklake.operators import tape

    won = F.col("won")
    rows = _scored(t).withColumn("gap", F.pow(F.col("p") - won, 2) - F.pow(F.col("m") - won, 2))
    return tape.bootstrap_mean(rows, "ord", "gap", 1000)
