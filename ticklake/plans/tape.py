"""Queries on trade tapes, deltas and their quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklake.operators import book, fills, quality, tape
from ticklake.operators.joins import range_join
from ticklake.operators.kept import folder, kept
from ticklake.operators.quantiles import distinct_over, distinct_sketches, quantiles
from ticklake.operators.ranges import neighbour, running
from ticklake.plans.bridge import query
from ticklake.sources import frames, markets, sinks
from ticklake.functions import money

SECOND = 1_000_000
DAY, WEEK_S = 86_400 * SECOND, 604_800


@query("s10_candles", "select ticker, t // 604800 * 604800 as bar, arg_min(price, (t, ord)) as open, max(price) as high, min(price) as low, arg_max(price, (t, ord)) as close, sum(size) as volume, count(*) as n from tape group by all")
def _(t):
    return tape.candles(t.tape, 604_800)


@query("s03_ordered_frames", "select ticker, ord, conn, seq, row_number() over (partition by ticker order by ord, seq) as place from ev")
def _(t):
    rank = F.when(F.col("kind") == "snapshot", 0).when(F.col("kind") == "delta", 1).otherwise(2)
    rows = t.frames.withColumns({"t_receipt": F.col("ord"), "channel_rank": rank})
    return frames.placed(rows, ["ticker"], DAY).select("ticker", "ord", "conn", "seq", "place")


@query("s09_dates", "select distinct day from ev where day >= 19000")
def _(t):
    root = folder(t.spark, "dated")
    t.ev.select("event_id", F.lpad(F.col("day").cast("string"), 6, "0").alias("date")).repartition("date").write.partitionBy("date").parquet(root)
    return sinks.dates(t.spark, root, "019000").select(F.col("date").cast("bigint").alias("day"))


@query("f01_valid_trades", "select flag, count(*) as n from tape where price between 5 and 95 and size > 10 group by flag")
def _(t):
    return t.tape.where("price between 5 and 95 and size > 10").groupBy("flag").agg(F.count("*").alias("n"))


@query("f05_series_prefix", "select p_brand, count(*) as n from part where starts_with(p_type, 'S') group by p_brand")
def _(t):
    return t("part").where(F.col("p_type").startswith("S")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("a01_null_counts", "select 'ticker' as column_name, count(*) - count(ticker) as n_null, round((count(*) - count(ticker)) / count(*), 6) as share from markets union all select 'result', count(*) - count(result), round((count(*) - count(result)) / count(*), 6) from markets union all select 'c_mktsegment', count(*) - count(c_mktsegment), round((count(*) - count(c_mktsegment)) / count(*), 6) from markets")
def _(t):
    return quality.null_counts(t.markets)


@query("a02_daily", "select t // 86400 as day, count(*) as n, sum(size) as volume, count(distinct ticker) as tickers from tape group by all")
def _(t):
    return t.tape.groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.countDistinct("ticker").alias("tickers"))


@query("a02_united_sketches", "select t // 2419200 as span, count(*) as n, true as near from tape group by all")
def _(t):
    daily = kept(distinct_sketches(t.tape.withColumn("day", F.floor(F.col("t") / 86400)), ["day"], "ticker"))
    about = distinct_over(daily.withColumn("span", F.floor(F.col("day") / 28)), ["span"])
    exact = t.tape.groupBy(F.floor(F.col("t") / 2_419_200).alias("span")).agg(F.countDistinct("ticker").alias("tickers"))
    return about.join(exact, "span").select("span", "n", (F.abs(F.col("about") - F.col("tickers")) <= F.greatest(F.lit(1), F.lit(0.05) * F.col("tickers"))).alias("near"))


@query("a03_per_market", "select ticker, count(*) as n, sum(size) as volume, round(avg(price), 6) as mean_price from tape group by ticker")
def _(t):
    return t.tape.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.round(F.avg("price"), 6).alias("mean_price"))


@query("a04_per_series", "select ticker % 7 as series, count(*) as n, sum(size) as volume, count(distinct ticker) as tickers from tape group by all")
def _(t):
    return t.tape.groupBy((F.col("ticker") % 7).alias("series")).agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.countDistinct("ticker").alias("tickers"))


@query("a05_side_balance", "select day, count(*) filter (taker = 'no') as no, count(*) filter (taker = 'yes') as yes from trades group by day")
def _(t):
    counted = t.trades.groupBy("day").pivot("taker", ["no", "yes"]).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


@query("a06_hourly", "select ord // 3600000000 % 24 as hour, count(*) as n, sum(size) as volume, count(distinct ticker) as tickers from trades group by all")
def _(t):
    hour = (F.floor(F.col("ord") / (3600 * SECOND)) % 24).alias("hour")
    return t.trades.groupBy(hour).agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.countDistinct("ticker").alias("tickers"))


@query("a07_batch_fills", ", g as (select ticker, t, count(*) as n from tape group by all having count(*) > 1) select count(*) as groups, max(n) as most, round(avg(n), 6) as mean from g")
def _(t):
    g = t.tape.groupBy("ticker", "t").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("a08_last_price", ", x as (select ticker, arg_max(price, (t, ord)) as last from tape group by ticker) select ticker, last, last <= 5 or last >= 95 as resolved from x")
def _(t):
    last = t.tape.groupBy("ticker").agg(F.max_by("price", F.struct("t", "ord")).alias("last"))
    return last.withColumn("resolved", (F.col("last") <= 5) | (F.col("last") >= 95))


@query("a09_liquidity", "select ticker, count(*) as n, sum(size) as volume, round(avg(price), 6) as mean_price, min(t) as first, max(t) as last, count(*) filter (flag = 'R') as yes, count(*) filter (flag <> 'R') as no, round(100.0 * count(*) filter (flag = 'R') / count(*), 6) as yes_percent, max(t) - min(t) as duration, round(count(*) / nullif((max(t) - min(t)) / 3600, 0), 6) as per_hour from tape group by ticker")
def _(t):
    return tape.profile(t.tape.withColumn("taker", F.when(F.col("flag") == "R", "yes").otherwise("no")), ["ticker"])


@query("a10_rollups", "select case when grouping(flag) = 0 then flag end as flag, case when grouping(l_suppkey % 5) = 0 then l_suppkey % 5 end as team, count(*) as n, sum(size) as volume from tape group by grouping sets ((flag), (l_suppkey % 5), (flag, l_suppkey % 5))")
def _(t):
    rows = t.tape.withColumn("team", F.col("l_suppkey") % 5)
    return rows.groupingSets([[F.col("flag")], [F.col("team")], [F.col("flag"), F.col("team")]], "flag", "team").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


@query("a11_latency", "select count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(min(value), 6) as least, round(max(value), 6) as most, count(*) filter (value < 0) as negative from ev")
def _(t):
    v = F.col("value")
    q = [F.round(F.lit(x), 6).alias(n) for x, n in zip(quantiles(t.ev, "value", [0.5, 0.95, 0.99]), ("p50", "p95", "p99"), strict=True)]
    return t.ev.agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), *q, F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.count_if(v < 0).alias("negative"))


@query("a13_quote_activity", """, q as (select ticker, bid, ask, spread, case when spread is null then 'one_sided' when spread <= 0 then 'crossed' when bid <= 10 or ask >= 90 then 'extreme_price' when spread < 4 then 'spread_narrow' else 'quote' end as reason from books),
  whole as (select count(*) filter (reason = 'quote') as active, count(*) filter (reason <> 'quote') as inactive, count(distinct ticker) as tickers, median(spread) as median_spread, round(avg(spread), 6) as mean_spread, min(spread) as least, max(spread) as most from q)
  select r.reason, r.n, whole.* from (select reason, count(*) as n from q group by reason) r, whole""")
def _(t):
    s = F.col("spread")
    reason = F.when(s.isNull(), "one_sided").when(s <= 0, "crossed").when((F.col("bid") <= 10) | (F.col("ask") >= 90), "extreme_price").when(s < 4, "spread_narrow").otherwise("quote")
    rows = kept(book.best(book.valid_books(book.depth(t.frames))).select("ticker", "spread", reason.alias("reason")))
    quoted = F.col("reason") == "quote"
    whole = rows.agg(F.count_if(quoted).alias("active"), F.count_if(~quoted).alias("inactive"), F.countDistinct("ticker").alias("tickers"), F.lit(quantiles(rows, "spread", [0.5])[0]).alias("median_spread"), F.round(F.avg(s), 6).alias("mean_spread"), F.min(s).alias("least"), F.max(s).alias("most"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole))  # one row


@query("a26_quantile_bins", ", e as (select list_distinct([quantile_cont(price, 0.0), quantile_cont(price, 0.2), quantile_cont(price, 0.4), quantile_cont(price, 0.6), quantile_cont(price, 0.8), quantile_cont(price, 1.0)]) as edges from trades), b as (select greatest(len(list_filter(edges, lambda x: x < price)), 1) as bin, size from trades, e) select bin, count(*) as n, round(avg(size), 6) as mean, round(stddev_samp(size), 6) as deviation from b group by bin")
def _(t):
    return tape.quantile_bins(t.trades, "price", 5, "size")


@query("a27_regression", "select round(corr(price, size), 6) as correlation, round(regr_slope(size, price), 6) as slope, round(regr_intercept(size, price), 6) as intercept from trades")
def _(t):
    return t.trades.agg(F.round(F.corr("price", "size"), 6).alias("correlation"), F.round(F.regr_slope("size", "price"), 6).alias("slope"), F.round(F.regr_intercept("size", "price"), 6).alias("intercept"))


@query("a28_bootstrap")
def _(t):
    return tape.bootstrap_mean(t.trades, "ord", "price", 1000)


@query("a30_series_scan", """, latest as (select ticker, arg_max(spread, ord) as spread, arg_max(bid, ord) as bid, arg_max(ask, ord) as ask from books where spread is not null group by ticker),
  vol as (select ticker, sum(size) as volume from trades group by ticker), m as (select cast(substr(v.ticker, 2) as int) % 7 as series, v.ticker, volume, case when bid > 0 and bid < ask and ask < 100 then spread end as spread from vol v left join latest l on l.ticker = v.ticker),
  s as (select series, count(*) as open_markets, count(spread) as books, median(spread) as median_spread, round(avg(spread), 6) as mean_spread, quantile_cont(spread, 0.25) as p25, quantile_cont(spread, 0.75) as p75, 100.0 * count(*) filter (spread >= 4) / count(spread) as pct_wide, sum(volume) as total_volume, median(volume) as median_volume, 100.0 * count(*) filter (volume > 0) / count(*) as traded_percent from m group by series having count(spread) > 0),
  x as (select *, median_spread >= 3 and open_markets >= 2 and total_volume >= 100 and pct_wide >= 30 as actionable from s)
  select series, open_markets, books, median_spread, mean_spread, p25, p75, round(pct_wide, 6) as pct_wide, cast(total_volume as bigint) as total_volume, median_volume, round(traded_percent, 6) as traded_percent, round(median_spread * ln(1 + open_markets) * ln(1 + total_volume) * pct_wide / 100, 6) as score, actionable, not actionable and median_spread >= 2 and open_markets >= 1 as near_miss from x""")
def _(t):
    latest = fills.latest_quotes(book.best(book.valid_books(book.depth(t.frames))).where("spread is not null"))
    volume = t.trades.groupBy("ticker").agg(F.sum("size").alias("volume"))
    markets = volume.join(latest, "ticker", "left").withColumn("series", F.expr("cast(substr(ticker, 2) as int) % 7"))
    return tape.series_scan(markets, least_markets=2, near_markets=1)


@query("a39_market_counts", "select case when grouping(result) = 0 then coalesce(result, '') end as result, case when grouping(c_mktsegment) = 0 then c_mktsegment end as segment, count(*) as n from (select coalesce(result, '') as result, c_mktsegment from markets) group by grouping sets ((result), (c_mktsegment))")
def _(t):
    rows = t.markets.select(F.coalesce("result", F.lit("")).alias("result"), F.col("c_mktsegment").alias("segment"))
    return rows.groupingSets([[F.col("result")], [F.col("segment")]], "result", "segment").agg(F.count("*").alias("n"))


@query("a40_delta_summary", "select count(*) as n, count(distinct ticker) as tickers, min(ord) as first, max(ord) as last, round(count(*) / ((max(ord) - min(ord)) / 60e6), 6) as per_minute, count(*) filter (side = 'yes') as yes, count(*) filter (side = 'no') as no, round(avg(cast(delta > 0 as int)), 6) as share_added, round(avg(cast(delta < 0 as int)), 6) as share_removed, round(count(*) / (select count(*) from snapshots), 6) as per_snapshot from deltas")
def _(t):
    kind, d = F.col("kind"), F.col("delta")
    rows, n = t.frames.where("kind in ('delta', 'snapshot')"), F.count_if(kind == "delta")
    of = lambda c: F.when(kind == "delta", c)
    minutes = (F.max(of(F.col("ord"))) - F.min(of(F.col("ord")))) / 60e6
    return rows.agg(
        n.alias("n"), F.countDistinct(of(F.col("ticker"))).alias("tickers"), F.min(of(F.col("ord"))).alias("first"), F.max(of(F.col("ord"))).alias("last"), F.round(F.try_divide(n, minutes), 6).alias("per_minute"), F.count_if(F.col("side") == "yes").alias("yes"), F.count_if(F.col("side") == "no").alias("no"),
        tape.share(of(d > 0)).alias("share_added"), tape.share(of(d < 0)).alias("share_removed"), F.round(F.try_divide(n, F.count_if(kind == "snapshot")), 6).alias("per_snapshot"),
    )


@query("a41_volume_distribution", ", c as (select ticker, count(*) as n from tape group by ticker) select median(n) as median_n, round(avg(n), 6) as mean_n, max(n) as most, count(*) filter (n = 1) as ones, count(*) filter (n >= 5) as five, count(*) filter (n >= 20) as twenty, count(*) filter (n >= 50) as fifty from c")
def _(t):
    n = F.col("n")
    return t.tape.groupBy("ticker").agg(F.count("*").alias("n")).agg(F.median(n).alias("median_n"), F.round(F.avg(n), 6).alias("mean_n"), F.max(n).alias("most"), F.count_if(n == 1).alias("ones"), F.count_if(n >= 5).alias("five"), F.count_if(n >= 20).alias("twenty"), F.count_if(n >= 50).alias("fifty"))


@query("a47_histogram", "select cast(least(floor((least(greatest(price, 1), 99) - 1) / (98.0 / 99)), 98) as int) as bin, count(*) as n from tape group by all")
def _(t):
    return tape.histogram(t.tape, "price", 1, 99, 99)


@query("a36_poll_intervals", ", g as (select ord - lag(ord) over (partition by ticker order by ord) as gap from trades) select round(avg(gap), 3) as mean, median(gap) as median_gap, min(gap) as least, max(gap) as most, round(quantile_cont(gap, 0.95), 3) as p95 from g where gap is not null")
def _(t):
    rows = neighbour(t.trades.select("ticker", "ord"), ["ticker"], ["ord"], DAY, ["ord"], "before").select((F.col("ord") - F.col("before.ord")).alias("gap")).where("gap is not null")
    middle, high = quantiles(rows, "gap", [0.5, 0.95])
    return rows.agg(F.round(F.avg("gap"), 3).alias("mean"), F.lit(middle).alias("median_gap"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.round(F.lit(high), 3).alias("p95"))


@query("w01_backward_times", ", x as (select ticker, t < lag(t) over (partition by ticker order by ord, t) as back from tape) select ticker, count(*) filter (back) as n_backward, count(*) as n from x group by ticker")
def _(t):
    return quality.backward_times(t.tape, "ticker", ["ord", "t"], "t", 1_000_000)


@query("w02_sequence_gaps", ", x as (select sid, seq - lag(seq) over (partition by sid order by seq) as jump from deltas) select sid, count(*) as n_gaps, sum(jump - 1) as missing, max(jump) as largest from x where jump > 1 group by sid")
def _(t):
    return quality.sequence_gaps(t.deltas, "sid", "seq")


@query("w03_inter_trade", ", x as (select ticker, t - lag(t) over (partition by ticker order by t, ord) as gap from tape) select ticker, count(*) as n, round(quantile_cont(gap, 0.25), 6) as p25, round(quantile_cont(gap, 0.5), 6) as p50, round(quantile_cont(gap, 0.75), 6) as p75, round(quantile_cont(gap, 0.9), 6) as p90, round(avg(gap), 6) as mean from x group by ticker having count(*) >= 5")
def _(t):
    return tape.inter_trade(t.tape, 5, ["t", "ord"], 52 * WEEK_S)


@query("w04_wait_for_opposite", ", x as (select ticker, ord, taker, min(case when taker = 'no' then ord end) over (partition by ticker order by ord rows between 1 following and unbounded following) as next_no from trades) select ticker, ord, next_no - ord as wait from x where taker = 'yes' and next_no is not null")
def _(t):
    return tape.next_opposite(t.trades, DAY).select("ticker", "ord", "wait")


@query("w06_first_and_last", "select ticker, arg_min(price, ord) as first_price, arg_max(price, ord) as last_price from trades group by ticker")
def _(t):
    return t.trades.groupBy("ticker").agg(F.min_by("price", "ord").alias("first_price"), F.max_by("price", "ord").alias("last_price"))


@query("w07_cumulative", "select ticker, ord, sum(size) over (partition by ticker order by ord) as total from trades")
def _(t):
    return running(t.trades, ["ticker"], ["ord"], DAY, total=("sum", "size")).select("ticker", "ord", "total")


_BINS = ", lastp as (select ticker, ord // 21600000000 as bin, arg_max(price, ord) as price from trades group by all), spans as (select ticker, unnest(range(min(bin), max(bin) + 1)) as bin from lastp group by ticker), filled as (select s.ticker, s.bin, last_value(l.price ignore nulls) over w as price, s.bin - max(case when l.price is not null then s.bin end) over w as stale from spans s left join lastp l on l.ticker = s.ticker and l.bin = s.bin window w as (partition by s.ticker order by s.bin rows between unbounded preceding and current row))"


@query("w09_w10_filled_bins", _BINS + "select ticker, bin, price, stale from filled")
def _(t):
    return tape.filled_bins(t.trades, 21_600 * SECOND)


@query("f10_staleness_filter", _BINS + "select ticker, count(*) as n from filled where stale <= 2 group by ticker")
def _(t):
    return tape.filled_bins(t.trades, 21_600 * SECOND).where("stale <= 2").groupBy("ticker").agg(F.count("*").alias("n"))


@query("w14_running_count", "select ticker, ord, row_number() over (partition by ticker order by ord) as running from trades")
def _(t):
    return tape.running_count(t.trades, "ticker", "ord", DAY).select("ticker", "ord", "running")


@query("o01_top_per_series", ", c as (select ticker % 7 as series, ticker, count(*) as n from tape group by all), r as (select *, row_number() over (partition by series order by n desc, ticker) as rank from c) select * from r where rank <= 15")
def _(t):
    counted = t.tape.groupBy((F.col("ticker") % 7).alias("series"), "ticker").agg(F.count("*").alias("n"))
    return tape.top_per_group(counted, "series", "n", "ticker", 15)


@query("o02_most_traded", "select ticker, n, has_conn from (select ticker, count(*) as n, ticker in (select ticker from snapshots where ord % 3 = 0) as has_conn from trades group by ticker) order by has_conn desc, n desc, ticker limit 1")
def _(t):
    scoped = t.frames.where("kind = 'snapshot' and ord % 3 = 0").select("ticker", F.lit(True).alias("seen")).distinct()  # those whose connection is known
    counted = t.trades.groupBy("ticker").agg(F.count("*").alias("n")).join(scoped, "ticker", "left")
    return counted.select("ticker", "n", F.coalesce("seen", F.lit(False)).alias("has_conn")).orderBy(F.desc("has_conn"), F.desc("n"), "ticker").limit(1)


@query("o05_every_nth", ", r as (select *, row_number() over (partition by ticker order by ord) as rn from trades) select ticker, ord, rn from r where rn % 10 = 0")
def _(t):
    return tape.running_count(t.trades, "ticker", "ord", DAY).withColumnRenamed("running", "rn").where("rn % 10 = 0").select("ticker", "ord", "rn")


@query("o06_best_parameter", ", s as (select p.cut, sum(case when price >= p.cut then size else -size end) as score from trades, (values (30), (40), (50), (60)) p(cut) group by p.cut) select arg_max(cut, (score, -cut)) as best, max(score) as score from s")
def _(t):
    cuts = F.explode(F.array(*[F.lit(c) for c in (30, 40, 50, 60)])).alias("cut")
    s = t.trades.select("price", "size", cuts).groupBy("cut").agg(F.sum(F.when(F.col("price") >= F.col("cut"), F.col("size")).otherwise(-F.col("size"))).alias("score"))
    return s.agg(F.max_by("cut", F.struct("score", -F.col("cut"))).alias("best"), F.max("score").alias("score"))


@query("o07_sweep_matrix", "select lo, sum(size) filter (price between lo and 60) as hi_60, sum(size) filter (price between lo and 70) as hi_70 from trades, (values (30), (40), (50)) a(lo) group by lo")
def _(t):
    lo, hi = F.explode(F.array(*[F.lit(c) for c in (30, 40, 50)])).alias("lo"), F.explode(F.array(F.lit(60), F.lit(70))).alias("hi")
    rows = t.trades.select("price", "size", lo).select("*", hi).where("price between lo and hi")
    out = rows.groupBy("lo").pivot("hi", [60, 70]).agg(F.sum("size"))
    return out.select("lo", F.col("60").alias("hi_60"), F.col("70").alias("hi_70"))


@query("u01_union_tape", "select ticker, ord, 'trade' as kind, price, size, null as delta from trades union all select ticker, ord, 'delta', price, null, delta from deltas")
def _(t):
    a = t.trades.select("ticker", "ord", F.lit("trade").alias("kind"), "price", "size")
    return a.unionByName(t.deltas.select("ticker", "ord", F.lit("delta").alias("kind"), "price", "delta"), allowMissingColumns=True)


@query("u02_duplicates", "select sum(c) as n, sum(c) - count(*) as n_duplicate from (select count(*) as c from tape group by ticker, t, price)")
def _(t):
    return quality.duplicates(t.tape, ["ticker", "t", "price"])


@query("u03_market_merge", """, live_m as (select ticker, 'live' as source, case when ticker % 2 = 0 then coalesce(result, '') else '' end as result, c_mktsegment, ticker as arrival from markets where ticker % 5 <> 0 union all select ticker, 'live', case ticker % 3 when 0 then 'no' else '' end, c_mktsegment, ticker + 1000000 from markets where ticker % 4 = 0),
  hist_m as (select ticker, 'historical' as source, coalesce(result, '') as result, c_mktsegment, ticker as arrival from markets where ticker % 7 <> 0 union all select ticker, 'historical', 'void', c_mktsegment, ticker + 5 from markets where ticker % 2 = 1),
  l as (select *, row_number() over (partition by ticker order by arrival desc) as rn from live_m), h as (select *, row_number() over (partition by ticker order by arrival) as rn, row_number() over (partition by ticker order by result = '', arrival) as rs from hist_m),
  p as (select *, case when result <> '' then 1 else 3 end as rank from l where rn = 1 union all select *, case when result <> '' and rs = 1 then 2 else 4 end from (select ticker, source, result, c_mktsegment, arrival, rn, rs from h where rn = 1 or rs = 1) by_name_h),
  r as (select ticker, source, result, c_mktsegment, row_number() over (partition by ticker order by rank, arrival) as k from (select ticker, source, result, c_mktsegment, arrival, rank from p)) select ticker, source, result, c_mktsegment from r where k = 1""".replace("union all select *, case when result <> '' and rs = 1 then 2 else 4 end from (select ticker, source, result, c_mktsegment, arrival, rn, rs from h where rn = 1 or rs = 1) by_name_h", "union all select ticker, source, result, c_mktsegment, arrival, rn, case when result <> '' and rs = 1 then 2 else 4 end from h where rn = 1 or rs = 1"))
def _(t):
    m, k = t.markets, F.col("ticker")
    made = lambda rows, source, result, at: rows.select("ticker", F.lit(source).alias("source"), result.alias("result"), "c_mktsegment", at.alias("arrival"))
    known = F.coalesce("result", F.lit(""))
    live = made(m.where(k % 5 != 0), "live", F.when(k % 2 == 0, known).otherwise(""), k).unionByName(made(m.where(k % 4 == 0), "live", F.when(k % 3 == 0, "no").otherwise(""), k + 1_000_000))
    old = made(m.where(k % 7 != 0), "historical", known, k).unionByName(made(m.where(k % 2 == 1), "historical", F.lit("void"), k + 5))
    return markets.merge(live, old, "arrival")


@query("u04_first_per_time", "select ticker, t, min(ord) as ord from tape group by all")
def _(t):
    return t.tape.groupBy("ticker", "t").agg(F.min("ord").alias("ord"))


@query("u05_fill_dedup", ", r as (select *, row_number() over (partition by ticker, day, side order by ord) as rn from fills) select ticker, day, side, ord from r where rn = 1")
def _(t):
    return t.fills.groupBy("ticker", "day", "side").agg(F.min("ord").alias("ord"))


_NEG = ", neg as (select ticker, ord as d_ord, side as d_side, price as d_price, -delta as d_size from deltas where delta < 0), used as (select ticker, ord, size, case when taker = 'yes' then 'no' else 'yes' end as side, case when taker = 'yes' then 100 - price else price end as cprice from trades)"


def _used(t):
    side, price = money.consumed(F.col("taker"), F.col("price"))
    return t.trades.select("ticker", "ord", "size", side.alias("side"), price.alias("cprice"))


def _negative(t):
    return t.deltas.where("delta < 0").select("ticker", F.col("ord").alias("d_ord"), "side", F.col("price").alias("cprice"), (-F.col("delta")).alias("d_size"), F.col("sid").alias("d_sid"), F.col("seq").alias("d_seq"))


@query("p11_consumed_side", _NEG + "select ticker, ord, side, cprice from used")
def _(t):
    return _used(t).drop("size")


@query("j06_delta_match", _NEG + "select ticker, ord from used u where exists (select 1 from neg n where n.ticker = u.ticker and d_side = side and d_price = cprice and d_ord between ord - 86400000000 and ord + 86400000000)")
def _(t):
    return range_join(_used(t), _negative(t), ["ticker", "side", "cprice"], "ord", "d_ord", 86_400 * SECOND, 86_400 * SECOND, "left_semi").select("ticker", "ord")


@query("j07_sequence_match", _NEG + ", shared as (select distinct t.sid from trades t join deltas d using (sid)), u2 as (select t.ticker, t.ord, t.sid, t.seq, u.side, u.cprice from trades t join used u on u.ticker = t.ticker and u.ord = t.ord) select ticker, ord from u2 t where t.sid in (select sid from shared) and exists (select 1 from deltas d where d.delta < 0 and d.ticker = t.ticker and d.sid = t.sid and d.side = t.side and d.price = t.cprice and d.seq between t.seq - 100 and t.seq + 100)")
def _(t):
    side, price = money.consumed(F.col("taker"), F.col("price"))
    left = t.trades.select("ticker", "sid", side.alias("side"), price.alias("cprice"), "ord", "seq")
    right = t.deltas.where("delta < 0").select("ticker", "sid", "side", F.col("price").alias("cprice"), F.col("seq").alias("d_seq"))
    return range_join(left, right, ["ticker", "sid", "side", "cprice"], "seq", "d_seq", 100, 100, "left_semi").select("ticker", "ord")  # a subscription of one side only meets nothing


@query("j08_exact_size_match", _NEG + "select ticker, ord from used u where exists (select 1 from neg n where n.ticker = u.ticker and d_side = side and d_price = cprice and d_size = size and d_ord between ord - 432000000000 and ord + 432000000000)")
def _(t):
    left, right = _used(t), _negative(t).withColumnRenamed("d_size", "size")
    return range_join(left, right, ["ticker", "side", "cprice", "size"], "ord", "d_ord", 432_000 * SECOND, 432_000 * SECOND, "left_semi").select("ticker", "ord")


@query("j09_forward_interval", "select s.ticker, s.ord, count(*) as n, arg_min(t.price, t.ord) as first_price, arg_max(t.price, t.ord) as last_price from snapshots s join trades t on t.ticker = s.ticker and t.ord between s.ord + 1 and s.ord + 21600000000 group by all having count(*) >= 2")
def _(t):
    snaps = t.frames.where("kind = 'snapshot'").select("ticker", "ord")
    pairs = range_join(snaps, t.trades.select("ticker", F.col("ord").alias("t_ord"), "price"), ["ticker"], "ord", "t_ord", -1, 21_600 * SECOND)
    return pairs.groupBy("ticker", "ord").agg(F.count("*").alias("n"), F.min_by("price", "t_ord").alias("first_price"), F.max_by("price", "t_ord").alias("last_price")).where("n >= 2")


@query("f04_delta_scope", "select s.ticker, s.ord, count(*) as n from (select *, case when ord % 4 <> 0 then conn end as c from snapshots) s join deltas d on d.ticker = s.ticker and ((c is not null and d.conn = c and d.ord > s.ord) or (c is null and d.ord between s.ord + 1 and s.ord + 14400000000)) group by all")
def _(t):
    snaps = t.frames.where("kind = 'snapshot'").select("ticker", F.when(F.col("ord") % 4 != 0, F.col("conn")).alias("conn"), "ord")
    return tape.scoped_deltas(snaps, t.deltas, 14_400 * SECOND, DAY)


@query("j19_common_tickers", "select ticker, count(*) as n from trades where ticker in (select ticker from snapshots) and ticker in (select ticker from deltas) group by ticker")
def _(t):
    have = lambda kind: t.frames.where(F.col("kind") == kind).select("ticker").distinct()
    both = t.trades.join(have("snapshot"), "ticker", "left_semi").join(have("delta"), "ticker", "left_semi")
    return both.groupBy("ticker").agg(F.count("*").alias("n"))


@query("j20_missing_markets", "select ticker from markets where ticker not in (select ticker from fills)")
def _(t):
    return t.markets.join(t.fills.select("ticker").distinct(), "ticker", "left_anti").select("ticker")


@query("d05_presence_and_gaps", ", g as (select *, ord - lag(ord) over w as gap, sid is distinct from lag(sid) over w and lag(ord) over w is not null as moved from deltas window w as (partition by ticker order by ord)) select count(conn) as conns, count(sid) as sids, count(seq) as seqs, count(*) filter (gap > 3600000000) as long_gaps, count(*) filter (moved) as sid_transitions, max(gap) as longest from g")
def _(t):
    rows = neighbour(t.deltas, ["ticker"], ["ord"], DAY, ["ord", "sid"], "before")
    gap = F.col("ord") - F.col("before.ord")
    moved = F.col("before").isNotNull() & ~F.col("sid").eqNullSafe(F.col("before.sid"))
    return rows.agg(F.count("conn").alias("conns"), F.count("sid").alias("sids"), F.count("seq").alias("seqs"), F.count_if(gap > 3600 * SECOND).alias("long_gaps"), F.count_if(moved).alias("sid_transitions"), F.max(gap).alias("longest"))


@query("d08_tape_summary", "select count(*) as n, count(distinct ticker) as n_tickers, min(ord) as first, max(ord) as last, min(price) as least, max(price) as most, count(*) filter (price not between 1 and 99) as bad_price, count(*) filter (size <= 0) as bad_size, (select sum(c) - count(*) from (select count(*) as c from trades group by ticker, ord, price, size, taker)) as n_duplicate, round(avg(cast(sid is not null as int)), 6) as exchange_share, round(avg(cast(seq is not null as int)), 6) as seq_share from trades")
def _(t):
    return quality.summary(t.trades.withColumn("t_exchange", F.when(F.col("sid").isNotNull(), F.col("ord"))), "ord", ["ticker", "ord", "price", "size", "taker"])
