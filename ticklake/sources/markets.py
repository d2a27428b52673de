"""Market metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.functions.game import parse_time
from ticklake.functions.money import loose_cents, parse_size

TEXTS = ("ticker", "series_ticker", "event_ticker", "title", "yes_sub_title", "no_sub_title", "status", "result")
TIMES = ("open_time", "close_time", "expiration_time", "settlement_time")
COUNTS = ("volume", "volume_24h")
PRICES = {"last_price_cents": "last_price", "settlement_value_cents": "settlement_value"}


def normalize(raw: DataFrame) -> DataFrame:
    """The 16 columns of the market table from raw records; what is missing is null, a missing result empty."""
    have = set(raw.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    columns = [(F.coalesce(text(c), F.lit("")) if c == "result" else text(c)).alias(c) for c in TEXTS]
    columns += [F.timestamp_micros((parse_time(text(c).cast("string")) * 1e6).cast("bigint")).alias(c) for c in TIMES]
    columns += [parse_size(text(c)).alias(c) for c in COUNTS]
    columns += [loose_cents(text(c)).alias(name) for name, c in PRICES.items()]
    return raw.select(*columns)


def merge(live: DataFrame, historical: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per ticker, of both tables' common columns: the last live row if it has a result; else the first historical row that
    has one; else the last live row; else the first historical row.

    First and last are by ``arrival``, a column of both; rows that it can't tell apart, or all rows without it, are told
    apart by their values, the greatest of which counts as last, so the result doesn't depend on partitions.
    """
    columns = [c for c in live.columns if c != arrival]
    row = F.struct(*columns)
    at = F.struct(F.col(arrival) if arrival else F.lit(0).alias("at"), row)
    sides = [side.select(*columns, *[arrival] * bool(arrival)).withColumn("__live", F.lit(k)) for k, side in ((True, live), (False, historical))]
    both = sides[0].unionByName(sides[1])
    has = F.coalesce("result", F.lit("")) != ""
    mine = both.groupBy("ticker").agg(
        F.max_by(row, F.when(F.col("__live"), at)).alias("live"), F.min_by(row, F.when(~F.col("__live") & has, at)).alias("settled"), F.min_by(row, F.when(~F.col("__live"), at)).alias("first")
    )
    done = F.when(F.coalesce("live.result", F.lit("")) != "", F.col("live"))
    return mine.select(F.coalesce(done, "settled", "live", "first").alias("b")).select("b.*")
