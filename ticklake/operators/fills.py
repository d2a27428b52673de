"""Quotes, passive fills, round trips, positions and profit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklake.functions.money import maker_fee_cents
from ticklake.operators.joins import asof
from ticklake.operators.ranges import running

#: Range of ``ord`` (a day of microseconds) that as-of joins and running values work at once.
WIDTH = 86_400_000_000


def quote_changes(bests: DataFrame) -> DataFrame:
    """Two-sided quotes that differ from the one before in their epoch; one-sided rows are passed over."""
    two = bests.where("bid is not null and ask is not null")
    before = F.lag(F.struct("bid", "ask")).over(Window.partitionBy("ticker", "epoch").orderBy("ord"))
    return two.withColumn("__before", before).where(~F.struct("bid", "ask").eqNullSafe(F.col("__before"))).drop("__before")


def latest_quotes(bests: DataFrame) -> DataFrame:
    """Each ticker's last best bid and offer: ticker, bid, ask, mid_x2."""
    return bests.groupBy("ticker").agg(F.max_by(F.struct("bid", "ask", "mid_x2"), "ord").alias("b")).select("ticker", "b.*")


def passive_fills(trades: DataFrame, quotes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Trades that would fill our quote at the best: at the bid by a NO taker a buy, at the ask by a YES taker a sell. The quote is that strictly before the trade."""
    at = asof(trades, quotes, ["ticker"], "ord", "ord", ["bid", "ask", "mid_x2"], exact=False, width=width)
    side = F.when((F.col("taker") == "no") & (F.col("price") <= F.col("bid")), "buy").when((F.col("taker") == "yes") & (F.col("price") >= F.col("ask")), "sell")
    return at.withColumn("fill_side", side).where("fill_side is not null")


def horizon_mids(rows: DataFrame, quotes: DataFrame, horizons: list[int], unit: int, width: int = WIDTH) -> DataFrame:
    """Rows once per horizon with the mid in force that much later: ``horizon`` and ``mid_later`` (twice the mid)."""
    every = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("later", F.col("ord") + F.col("horizon").cast("bigint") * unit)
    return asof(every, quotes.withColumnRenamed("mid_x2", "mid_later"), ["ticker"], "later", "ord", ["mid_later"], width=width).drop("later", "asof_on")


def adverse_selection(fills: DataFrame, quotes: DataFrame, horizons: list[int], unit: int) -> DataFrame:
    """Per fill and horizon: how far the mid moved against it, and half-spread less that and the maker fee, in cents."""
    later = horizon_mids(fills, quotes, horizons, unit)
    sign = F.when(F.col("fill_side") == "buy", 1).otherwise(-1)
    adverse = sign * (F.col("mid_x2") - F.col("mid_later")) / 2
    edge = (F.col("ask") - F.col("bid")) / 2 - adverse - maker_fee_cents(F.col("price"))
    return later.withColumn("adverse", adverse).withColumn("edge", edge)


def unit_ranks(fills: DataFrame, width: int = WIDTH) -> DataFrame:
    """Fills with their rank within ticker and side."""
    return running(fills, ["ticker", "side"], ["ord"], width, rn=("count", F.lit(1)))


def round_trips(fills: DataFrame) -> DataFrame:
    """The i-th buy of a ticker with its i-th sell, which is first-in-first-out pairing of unit fills: profit in cents after maker fees."""
    ranked = unit_ranks(fills)
    side = lambda s: ranked.where(F.col("side") == s).select("ticker", "rn", F.col("ord").alias(f"{s}_ord"), F.col("price").alias(f"{s}_price"))
    fee = maker_fee_cents(F.col("buy_price")) + maker_fee_cents(F.col("sell_price"))
    both = side("buy").join(side("sell"), ["ticker", "rn"])
    return both.withColumn("fee", fee).withColumn("pnl", F.col("sell_price") - F.col("buy_price") - F.col("fee"))


def unpaired(fills: DataFrame) -> DataFrame:
    """Fills of the longer side beyond the pairs: the last abs(position) of a ticker."""
    ranked = unit_ranks(fills)
    n = ranked.groupBy("ticker").agg(F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"))
    return ranked.join(n, "ticker").where("rn > least(buys, sells)").drop("buys", "sells")


def positions(fills: DataFrame, size: str = "n") -> DataFrame:
    """Net position of each ticker that isn't flat."""
    signed = F.when(F.col("side") == "buy", F.col(size)).otherwise(-F.col(size))
    return fills.groupBy("ticker").agg(F.sum(signed).alias("position")).where("position <> 0")


def settlement_pnl(open_fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Profit in cents of unit fills at settlement: a YES result pays a buyer 100 - price, else -price; a seller the opposite."""
    known = open_fills.join(markets.where("result is not null").select("ticker", "result"), "ticker")
    buyer = F.when(F.col("result") == "yes", 100 - F.col("price")).otherwise(-F.col("price"))
    return known.withColumn("pnl", F.when(F.col("side") == "buy", buyer).otherwise(-buyer))


def running_position(fills: DataFrame, size: str = "n", width: int = WIDTH) -> DataFrame:
    """Fills with the ticker's position before and after each."""
    signed = F.when(F.col("side") == "buy", F.col(size)).otherwise(-F.col(size))
    held = running(fills.withColumn("__signed", signed), ["ticker"], ["ord"], width, after=("sum", "__signed"))
    return held.withColumn("before", F.col("after") - F.col("__signed")).drop("__signed")


def capped(fills: DataFrame, cap: int, width: int = WIDTH) -> DataFrame:
    """Unit fills until the position's size reaches the cap; none of the ticker after that."""
    unit = F.when(F.col("side") == "buy", 1).otherwise(-1)
    held = running(fills, ["ticker"], ["ord"], width, __after=("sum", unit))
    held = running(held, ["ticker"], ["ord"], width, inclusive=False, __most=("max", F.abs("__after")))
    return held.where(F.coalesce("__most", F.lit(0)) < cap).drop("__after", "__most")


def pnl_curve(trips: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per ticker the profit of round trips as they close: ord, total, its peak so far (0 at least) and the drawdown from it."""
    closed = trips.select("ticker", F.greatest("buy_ord", "sell_ord").alias("ord"), "pnl")
    total = running(closed, ["ticker"], ["ord"], width, total=("sum", "pnl"))
    curve = running(total, ["ticker"], ["ord"], width, __peak=("max", "total")).withColumn("peak", F.greatest(F.lit(0), "__peak"))
    return curve.select("ticker", "ord", "total", "peak", (F.col("peak") - F.col("total")).alias("drawdown"))


def episodes(fills: DataFrame, size: str = "n", width: int = WIDTH) -> DataFrame:
    """Fills with the ticker's position ``before`` and ``after`` each, and ``episode``, which counts its returns to flat before them."""
    return running(running_position(fills, size, width), ["ticker"], ["ord"], width, inclusive=False, episode=("sum", (F.col("after") == 0).cast("int")))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds cost, entry and realized to fills sorted by ticker, episode and ord (columns 0 to 2; then position before and after, price)."""
    key, cost, entry = None, 0.0, None
    for batch in batches:
        held = []
        for ticker, episode, _, before, after, price in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
            if (ticker, episode) != key:
                key, cost, entry = (ticker, episode), 0.0, None
            step, won = after - before, 0.0
            if before * step < 0:
                closed = min(abs(step), abs(before))
                won = closed * (price - entry) * (1 if before > 0 else -1)
            if after == 0:
                cost, entry = 0.0, None
            elif before * step >= 0:  # from flat or further out
                cost += price * step
                entry = abs(cost / after)
            elif abs(after) < abs(before):
                cost = cost * after / before  # exact where the cost is: a ratio of positions rarely is
            held.append((cost, entry, won))
        columns = [pa.array([h[k] for h in held], pa.float64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "cost", "entry", "realized"])


def average_cost(fills: DataFrame, size: str = "n", width: int = WIDTH) -> DataFrame:
    """Fills with the average cost of the position after each: ticker, episode, ord, before, after, price, cost, entry, realized.

    A fill that opens or extends a position adds price times size to its cost, and ``entry`` is cost by position. One that
    reduces it keeps entry and scales the cost; at 0 both end. One that turns it round to a smaller position scales the
    cost too, to an equal or larger one it leaves the cost; either way entry stays. ``realized`` is what the closed part
    won against entry, in price units. Positions between two returns to flat don't depend on each other, so each is dealt,
    sorted and folded on its own, in Arrow batches; a task keeps one cost.
    """
    rows = episodes(fills, size, width).select("ticker", F.col("episode").cast("bigint"), "ord", F.col("before").cast("double"), F.col("after").cast("double"), F.col("price").cast("double"))
    schema = rows.schema.add("cost", "double").add("entry", "double").add("realized", "double")
    return rows.repartition("ticker", "episode").sortWithinPartitions("ticker", "episode", "ord").mapInArrow(_costs, schema)


def open_costs(costs: DataFrame) -> DataFrame:
    """Open positions of ``average_cost``'s rows: ticker, position, cost and entry, its cost by contract in whole cents."""
    last = costs.groupBy("ticker").agg(F.max_by(F.struct("after", "cost"), "ord").alias("l")).where("l.after <> 0")
    return last.select("ticker", F.col("l.after").cast("bigint").alias("position"), "l.cost", F.rint(F.abs("l.cost") / F.abs("l.after")).cast("bigint").alias("entry"))


def marked(positions: DataFrame) -> DataFrame:
    """Positions with ``mid`` (cents, null without a book) and ``mtm``, what they would win at it in cents; 0 without a book."""
    mtm = F.when(F.col("position") > 0, (F.col("mid") - F.col("entry")) * F.col("position")).otherwise((F.col("entry") - F.col("mid")) * -F.col("position"))
    return positions.withColumn("mtm", F.coalesce(mtm, F.lit(0.0)))


def portfolio(costs: DataFrame, marked_positions: DataFrame) -> DataFrame:
    """One row: open tickers, gross and net contracts, realized and maker fees in dollars, mark to market in cents, and what is left of all."""
    fees = maker_fee_cents(F.col("price")) * F.abs(F.col("after") - F.col("before"))
    done = costs.agg((F.sum("realized") / 100).alias("realized"), (F.sum(fees) / 100).alias("fees"))
    held = marked_positions.agg(F.count("*").alias("open_tickers"), F.sum(F.abs("position")).alias("gross"), F.sum("position").alias("net"), F.sum("mtm").alias("mtm"))
    net = F.col("realized") - F.col("fees") + F.col("mtm") / 100
    return held.crossJoin(done).select("open_tickers", "gross", "net", *[F.round(c, 6).alias(c) for c in ("realized", "fees", "mtm")], F.round(net, 6).alias("net_pnl"))  # one row each


def settled(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Per settled ticker payout less cost and maker fees, in cents: ticker, pnl, fee."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    cost = fills.groupBy("ticker").agg(F.sum(sign * F.col("price") * F.col("n")).alias("cost"), F.sum(sign * F.col("n")).alias("q"), F.sum(maker_fee_cents(F.col("price")) * F.col("n")).alias("fee"))
    payout = F.when(F.col("result") == "yes", 100 * F.col("q")).otherwise(0)
    return cost.join(markets.select("ticker", "result"), "ticker").select("ticker", (payout - F.col("cost") - F.col("fee")).alias("pnl"), "fee")


def reconcile(internal: DataFrame, actual: DataFrame) -> DataFrame:
    """Tickers whose two positions differ; a missing one is 0."""
    both = internal.select("ticker", F.col("position").alias("internal")).join(actual.select("ticker", F.col("position").alias("actual")), "ticker", "full_outer")
    return both.select("ticker", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("actual", F.lit(0)).alias("actual")).where("internal <> actual")


def queue_fills(orders: DataFrame, trades: DataFrame, width: int) -> DataFrame:
    """What resting orders (order_id, ticker, side, price, placed, until, queue_ahead, remaining) get of the trades at their price.

    A trade's size beyond the queue ahead fills the order until its size is used up. Time is cut into buckets of
    ``width``, about as long as orders rest, so that a hot price's orders meet only the trades of their time.
    """
    bucket = lambda c: F.floor(c / width).cast("bigint")
    resting = orders.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("placed")), bucket(F.greatest("placed", "until"))))).withColumn("taker", F.when(F.col("side") == "buy", "no").otherwise("yes"))
    taken = trades.select("ticker", "price", "taker", F.col("ord").alias("at"), "size", bucket(F.col("ord")).alias("__bucket"))
    hits = resting.join(taken, ["ticker", "price", "taker", "__bucket"]).where("at > placed and at <= until")
    w = Window.partitionBy("order_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    avail = F.greatest(F.col("size") - F.col("queue_ahead"), F.lit(0))
    summed = hits.withColumn("avail", avail).withColumn("cum", F.sum("avail").over(w))
    got = F.least("remaining", "cum") - F.least(F.col("remaining"), F.col("cum") - F.col("avail"))
    return summed.withColumn("filled", got).where("filled > 0").select("order_id", "ticker", "at", "filled")


def lineage(fills: DataFrame, orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fills with the order that they belong to and the ticker's quote in force when that order was placed."""
    placed = fills.join(orders.select("order_id", F.col("ord").alias("placed")), "order_id")
    return asof(placed, quotes, ["ticker"], "placed", "ord", ["bid", "ask"], width=WIDTH)
