"""Two markets on one game, and two tapes of one market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.functions.money import entry_fees
from ticklake.operators.joins import asof
from ticklake.operators.kept import kept
from ticklake.operators.quantiles import quantiles
from ticklake.operators.ranges import neighbour
from ticklake.operators.tape import filled_bins


def divergence(legs: DataFrame, width: int, most_stale: int) -> DataFrame:
    """Game less spread price per game and bin, both filled forward, where neither leg is staler than ``most_stale`` bins."""
    keyed = legs.select(F.struct("game", "leg").alias("ticker"), "ord", "price")
    filled = filled_bins(keyed, width).select("ticker.*", "bin", "price", "stale")
    side = lambda s: filled.where(F.col("leg") == s).select("game", "bin", F.col("price").alias(f"{s}_price"), F.col("stale").alias(f"{s}_stale"))
    both = side("game").join(side("spread"), ["game", "bin"])
    out = both.select("game", "bin", (F.col("game_price") - F.col("spread_price")).alias("divergence"), F.greatest("game_stale", "spread_stale").alias("stale"))
    return out.where(F.col("stale") <= most_stale)


def executable(quotes: DataFrame) -> DataFrame:
    """The better of selling the game leg against the spread leg, or the other way, at the prices quoted."""
    game, spread = F.col("game_bid") - F.col("spread_ask"), F.col("spread_bid") - F.col("game_ask")
    return quotes.withColumn("best", F.greatest(game, spread)).withColumn("direction", F.when(game >= spread, "sell_game").otherwise("sell_spread"))


def divergence_stats(quotes: DataFrame, thin: int = 50) -> DataFrame:
    """One row on both legs' quotes with sizes: the gap of their mids beside what can be executed, each with mean, median,
    deviation and shares over 3, 5 and 10 cents; what crossing costs; and the depth where more than 3 cents can be had."""
    d = (F.col("game_ask") + F.col("game_bid") - F.col("spread_ask") - F.col("spread_bid")) / 2
    depth = F.when(F.col("direction") == "sell_game", F.least("game_bid_size", "spread_ask_size")).otherwise(F.least("spread_bid_size", "game_ask_size"))
    costs = {"game_cost": F.col("game_ask") - F.col("game_bid"), "spread_cost": F.col("spread_ask") - F.col("spread_bid")}
    rows = kept(executable(quotes).withColumns({"d": d, "depth": depth, **costs}).select("d", F.col("best").alias("x"), "depth", *costs))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    middle = lambda c: quantiles(rows, c, [0.5])[0]
    parts = [F.count("*").alias("n")]
    for c, names in (("d", ("mean", "median_d", "deviation", "over_")), ("x", ("mean_x", "median_x", "deviation_x", "x_over_"))):
        parts += [F.round(F.avg(c), 6).alias(names[0]), F.lit(middle(c)).cast("double").alias(names[1]), F.round(F.stddev_samp(c), 6).alias(names[2]), *[share(F.col(c) > k).alias(f"{names[3]}{k}") for k in (3, 5, 10)]]
    large = F.when(F.col("x") > 3, F.col("depth"))
    parts += [F.lit(middle(F.col("game_cost") + F.col("spread_cost"))).cast("double").alias("crossing"), F.round(F.avg("game_cost"), 6).alias("game_cost"), F.round(F.avg("spread_cost"), 6).alias("spread_cost")]
    return rows.agg(*parts, F.lit(middle(large)).cast("double").alias("depth_over_3"), share(large < thin).alias("thin_over_3"))


def tape_diff(live: DataFrame, replay: DataFrame, columns: list[str], width: int) -> DataFrame:
    """Where two quote tapes (ticker, ord, ``columns``) differ: ticker, ord, live and replay (structs), until.

    A quote holds until its tape's next one. At each time of either tape both last quotes are compared; a row says from
    when to when, or to the end (null), they differ. A tape without a quote so far has null and differs from one with.
    Of a tape's quotes at one time the greatest counts. ``width`` as in ``joins.asof``.
    """
    times = live.select("ticker", "ord").unionByName(replay.select("ticker", "ord")).distinct()
    held = times
    for name, one in (("live", live), ("replay", replay)):
        quotes = one.select("ticker", "ord", F.struct(*columns).alias(name))
        held = asof(held, quotes, ["ticker"], "ord", "ord", [name], width=width).drop("asof_on")
    ends = neighbour(held, ["ticker"], ["ord"], width, ["ord"], "next", ahead=True)
    return ends.where(~F.col("live").eqNullSafe(F.col("replay"))).select("ticker", "ord", "live", "replay", F.col("next.ord").alias("until"))


def pair_entries(rows: DataFrame, least: float) -> DataFrame:
    """Per game the first matched row (game, ord, game_price, spread_price) whose prices are more than ``least`` apart, with ``gap``, game less spread."""
    apart = rows.withColumn("gap", F.col("game_price") - F.col("spread_price")).where(F.abs("gap") > least)
    return apart.groupBy("game").agg(F.min_by(F.struct("ord", "game_price", "spread_price", "gap"), "ord").alias("e")).select("game", "e.*")


def pair_fee(game_price: str, spread_price: str) -> Column:
    """Dollars for one contract of each leg at prices in cents: the game leg as maker, the spread leg as taker."""
    return entry_fees(F.col(game_price) / 100, F.col(spread_price) / 100, 1)


def settled_pairs(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entries held to settlement, of games with an outcome (game, won by the team, margin): ``outcome``, fee, pnl in dollars, game_leg and spread_leg.

    A rich game leg is sold against the spread leg, or the other way. Both legs pay alike when the team loses or wins by
    two; a win by one pays the game leg only, which costs the seller of it a dollar and gives its buyer one.
    """
    one = F.col("won") & (F.col("margin") == 1)
    outcome = F.when(~F.col("won"), "loses").when(one, "wins_by_one").otherwise("wins_by_two")
    fee = pair_fee("game_price", "spread_price")
    pay = F.when(one & (F.col("gap") > 0), -1.0).when(one, 1.0).otherwise(0.0)
    legs = {"game_leg": F.col("won").cast("int"), "spread_leg": (F.col("won") & (F.col("margin") >= 2)).cast("int")}
    held = entries.join(outcomes, "game").withColumns({"outcome": outcome, "direction": F.when(F.col("gap") > 0, "sell_game").otherwise("buy_game"), "fee": fee, **legs})
    return held.withColumn("pnl", F.abs("gap") / 100 + pay - fee)


def converged_pairs(entries: DataFrame, rows: DataFrame, outcomes: DataFrame, level: float) -> DataFrame:
    """Entries closed at the first later matched row whose prices are less than ``level`` apart, else held to settlement if there is an outcome.

    Adds exit, exit_gap, kind (converged or settlement), hold in minutes, fee (of both trades of both legs, if closed) and pnl in dollars.
    """
    later = rows.select("game", F.col("ord").alias("exit"), F.col("game_price").alias("exit_game"), F.col("spread_price").alias("exit_spread"))
    close = F.abs(F.col("exit_game") - F.col("exit_spread")) < level
    hits = entries.join(later, "game").where((F.col("exit") > F.col("ord")) & close).groupBy("game").agg(F.min_by(F.struct("exit", "exit_game", "exit_spread"), "exit").alias("x")).select("game", "x.*")
    held = settled_pairs(entries, outcomes).select("game", F.col("pnl").alias("settled"), "outcome")
    both = entries.join(hits, "game", "left").join(held, "game", "left").where("exit is not null or settled is not null")
    gap, closed = F.col("exit_game") - F.col("exit_spread"), F.col("exit").isNotNull()
    fee = pair_fee("game_price", "spread_price")
    out = pair_fee("exit_game", "exit_spread")
    won = F.when(F.col("gap") > 0, F.col("gap") - gap).otherwise(gap - F.col("gap")) / 100
    return both.withColumns({"exit_gap": gap, "kind": F.when(closed, "converged").otherwise("settlement"), "hold": (F.col("exit") - F.col("ord")) / 60e6, "fee": F.when(closed, fee + out).otherwise(fee), "pnl": F.when(closed, won - fee - out).otherwise(F.col("settled"))})
