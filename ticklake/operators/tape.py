"""Statistics of trade tapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.operators.joins import asof, range_join
from ticklake.operators.quantiles import quantiles
from ticklake.operators.ranges import neighbour, running

# fixed values: the distribution function of a Poisson count of mean 1
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def candles(trades: DataFrame, width: int, time: str = "t", order: str = "ord") -> DataFrame:
    """Open, high, low, close, volume and count per ticker and bar of ``width`` time units."""
    bar = (F.floor(F.col(time) / width) * width).cast("bigint").alias("bar")
    at = F.struct(time, order)
    return trades.groupBy("ticker", bar).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin of equal width on [low, high]; values outside are clipped to it."""
    x = F.least(F.greatest(F.col(column).cast("double"), F.lit(float(low))), F.lit(float(high)))
    k = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def profile(trades: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Liquidity of each group: trades, volume, mean price, first and last time, YES and NO takers and the former's percent, duration, trades an hour (null if all at once)."""
    hours, yes = (F.max(time) - F.min(time)) / 3600, F.count_if(F.col("taker") == "yes")
    sides = [yes.alias("yes"), F.count_if(F.col("taker") == "no").alias("no"), F.round(100 * F.try_divide(yes, F.count("*")), 6).alias("yes_percent")]
    return trades.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.round(F.avg("price"), 6).alias("mean_price"), F.min(time).alias("first"), F.max(time).alias("last"), *sides, (F.max(time) - F.min(time)).alias("duration"), F.round(F.try_divide(F.count("*"), hours), 6).alias("per_hour"))


def top_per_group(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the greatest score: each task keeps its own best first, by Spark's window group limit."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def inter_trade(trades: DataFrame, least: int, order: list[str], width: int, time: str = "t") -> DataFrame:
    """Quantiles of the time between a ticker's trades, for tickers with ``least`` or more; ``width`` as in ``ranges.neighbour``."""
    before = neighbour(trades, ["ticker"], order, width, [time], "__before")
    gaps = before.withColumn("gap", F.col(time) - F.col(f"__before.{time}")).groupBy("ticker").agg(F.count("*").alias("n"), F.percentile("gap", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)])).alias("q"), F.avg("gap").alias("mean"))
    return gaps.where(F.col("n") >= least).select("ticker", "n", *[F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(("p25", "p50", "p75", "p90"))], F.round("mean", 6).alias("mean"))


def next_opposite(trades: DataFrame, width: int) -> DataFrame:
    """Per YES trade of a ticker the wait to its next NO trade; ``width`` as in ``joins.asof``."""
    ahead = asof(trades.where("taker = 'yes'"), trades.where("taker = 'no'"), ["ticker"], "ord", "ord", [], exact=False, forward=True, width=width)
    return ahead.withColumnRenamed("asof_on", "next_no").where("next_no is not null").withColumn("wait", F.col("next_no") - F.col("ord"))


def quantile_bins(rows: DataFrame, column: str, bins: int, value: str) -> DataFrame:
    """Mean and deviation of ``value`` per quantile bin of ``column``; equal edges are one. Bins are open below, but for the first."""
    found = quantiles(rows, column, [k / bins for k in range(bins + 1)])
    edges = F.array(*[F.lit(e) for e in sorted({e for e in found if e is not None})]).cast("array<double>")
    k = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(column))), F.lit(1))
    return rows.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("deviation"))


def bootstrap_mean(rows: DataFrame, key: str, value: str, rounds: int, seed: int = 42) -> DataFrame:
    """95 % interval of the mean by a Poisson bootstrap: every row draws a weight per round from a hash of its key, a whole
    number, so the result doesn't depend on partitions. A task adds up all rounds at once and sends one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        round_ = (np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
        total = np.zeros((2, rounds))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                k, v = (batch.column(c).slice(lo, 1000).to_numpy(zero_copy_only=False) for c in (0, 1))
                h = (k.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None] ^ round_
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
                weight = np.searchsorted(_POISSON, u)
                total += np.stack([v.astype(float) @ weight, weight.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, rounds + 1)), pa.array(total[0]), pa.array(total[1])], ["round", "total", "weight"])

    known = rows.select(F.col(key).cast("bigint"), F.col(value).cast("double")).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    sums = known.mapInArrow(run, "round bigint, total double, weight double")
    means = sums.groupBy("round").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg("m").alias("mean"))


def scoped_deltas(snapshots: DataFrame, deltas: DataFrame, span: int, width: int) -> DataFrame:
    """Per snapshot (ticker, conn, ord) the number of deltas that follow it: all later ones of its connection, or those within ``span`` where it names none.

    Later ones of a connection aren't joined but counted from the end: deltas and snapshots run along one order.
    """
    known = snapshots.where("conn is not null").select("ticker", "conn", "ord", F.lit(0).alias("one"))
    both = known.unionByName(deltas.select("ticker", "conn", "ord", F.lit(1).alias("one")))
    behind = running(both.withColumn("back", -F.col("ord")), ["ticker", "conn"], ["back", "one"], width, n=("sum", "one"))
    after = behind.where("one = 0 and n > 0").select("ticker", "ord", "n")
    near = range_join(snapshots.where("conn is null").select("ticker", "ord"), deltas.select("ticker", F.col("ord").alias("d_ord")), ["ticker"], "ord", "d_ord", -1, span)
    return after.unionByName(near.groupBy("ticker", "ord").agg(F.count("*").alias("n")))


def series_scan(markets: DataFrame, wide: int = 4, least_spread: int = 3, least_markets: int = 20, least_volume: int = 100, least_wide: float = 30, near_spread: int = 2, near_markets: int = 10) -> DataFrame:
    """How a series of markets (series, volume, and bid and ask of the latest book, null without one) suits a market maker.

    Only books with 0 < bid < ask < 100 count; a series without any is left out. ``score`` is the median spread times the
    logarithms of open markets and volume times the share of spreads of ``wide`` cents or more. ``actionable`` series pass
    all four least values; near misses pass the two looser ones and aren't actionable.
    """
    spread = F.when((F.col("bid") > 0) & (F.col("bid") < F.col("ask")) & (F.col("ask") < 100), F.col("ask") - F.col("bid"))
    rows = markets.withColumn("spread", spread)
    percent = lambda of, all_: 100 * F.try_divide(F.count_if(of), all_)
    quartile = lambda q: F.percentile("spread", F.lit(q))
    found = rows.groupBy("series").agg(
        F.count("*").alias("open_markets"), F.count("spread").alias("books"), F.median("spread").alias("median_spread"), F.round(F.avg("spread"), 6).alias("mean_spread"), quartile(0.25).alias("p25"), quartile(0.75).alias("p75"),
        percent(F.col("spread") >= wide, F.count("spread")).alias("pct_wide"), F.sum("volume").alias("total_volume"), F.median("volume").alias("median_volume"), F.round(percent(F.col("volume") > 0, F.count("*")), 6).alias("traded_percent"),
    ).where("books > 0")
    score = F.col("median_spread") * F.log1p("open_markets") * F.log1p("total_volume") * F.col("pct_wide") / 100
    actionable = (F.col("median_spread") >= least_spread) & (F.col("open_markets") >= least_markets) & (F.col("total_volume") >= least_volume) & (F.col("pct_wide") >= least_wide)
    near = ~actionable & (F.col("median_spread") >= near_spread) & (F.col("open_markets") >= near_markets)
    return found.withColumns({"score": F.round(score, 6), "actionable": actionable, "near_miss": near, "pct_wide": F.round("pct_wide", 6)})


def filled_bins(trades: DataFrame, width: int, time: str = "ord") -> DataFrame:
    """Last price per ticker and bin, with the bins between the ticker's first and last trade filled forward, and ``stale``, the bins since a trade."""
    bin_no = F.floor(F.col(time) / width).cast("bigint")
    last = trades.groupBy("ticker", bin_no.alias("bin")).agg(F.max_by("price", time).alias("price"))
    spans = last.groupBy("ticker").agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    w = Window.partitionBy("ticker").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    traded = F.when(F.col("price").isNotNull(), F.col("bin"))
    return spans.join(last, ["ticker", "bin"], "left").select("ticker", "bin", F.last("price", ignorenulls=True).over(w).alias("price"), (F.col("bin") - F.max(traded).over(w)).alias("stale"))


def running_count(rows: DataFrame, key: str, order: str, width: int) -> DataFrame:
    return running(rows, [key], [order], width, running=("count", F.lit(1)))


def share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("int")), 6)
