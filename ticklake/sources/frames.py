"""Archived frames: one JSON document a line, in text files that may be gzipped, by channel and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.functions.game import parse_time
from ticklake.functions.money import dollars_to_cents, parse_size, seconds_to_ns
from ticklake.operators.ranges import running

# fixed values: channel names, in the order of frames received at the same time
CHANNELS = ("orderbook_snapshot", "orderbook_delta", "trade")
_TEXTS = ("market_ticker", "market_id", "price_dollars", "delta_fp", "side", "yes_price_dollars", "no_price_dollars", "count_fp", "count", "taker_side", "ts", "order_id", "action", "status", "position")
_LEVELS = T.ArrayType(T.ArrayType(T.StringType()))
MESSAGE = T.StructType([T.StructField(c, T.StringType()) for c in _TEXTS] + [T.StructField(f"{s}_dollars_fp", _LEVELS) for s in ("yes", "no")])
FRAME = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("t_receipt", T.DoubleType()),
        T.StructField("conn_id", T.StringType()),
        T.StructField("frame", T.StructType([T.StructField("type", T.StringType()), T.StructField("sid", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("msg", MESSAGE)])),
    ]
)


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Non-blank lines of text files with their file; no rows where no path exists."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "value string, file string")
    return spark.read.text(there).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def parse(lines: DataFrame) -> DataFrame:
    """Frames of lines (column ``value``), by the fixed schema; lines that aren't JSON are left out."""
    parsed = lines.select(F.from_json("value", FRAME).alias("f")).where("f.frame is not null")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("type")), F.lit(0))
    return parsed.select(F.coalesce("f.t_receipt", F.lit(0.0)).alias("t_receipt"), "f.conn_id", "f.source", "f.channel", "f.frame.*").withColumn("channel_rank", rank)


def read_date(spark: SparkSession, root: str, date: str) -> DataFrame:
    """All channels' frames of a date: the merged file of each channel where there is one, else the raw files."""
    parts = []
    for channel in CHANNELS:
        merged = f"{root}/channel={channel}/date={date}/merged*"
        parts.append(read_lines(spark, merged if _exists(spark, merged) else f"{root}/channel={channel}/date={date}/*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return parse(out)


def order_key() -> list[Column]:
    """Order of frames: receipt, then snapshots, deltas and trades, then sequence number."""
    return [F.col("t_receipt"), F.col("channel_rank"), F.col("seq")]


def placed(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows with ``place``, their number in the order of ``order_key`` under the keys; receipts are worked in ranges of ``width``."""
    return running(rows, keys, ["t_receipt", "channel_rank", "seq"], width, place=("count", F.lit(1)))


def _levels(side: str) -> Column:
    array = F.coalesce(F.col(f"msg.{side}_dollars_fp"), F.array().cast("array<array<string>>"))
    return F.transform(array, lambda x: F.struct(F.lit(side).alias("side"), dollars_to_cents(x[0]).alias("price"), parse_size(x[1]).alias("qty")))


def to_book_frames(parsed: DataFrame, width: int = 3_600_000_000_000) -> DataFrame:
    """The frames that books are built of, as ``operators.book`` takes them; ``ord`` is the receipt in nanoseconds.

    Frames of a ticker stand in the order of ``order_key``, then of the connection. Each has an ``ord`` of its own: its
    receipt, or one more than the frame's before it where that is later, however many share a receipt. Time is worked in
    ranges of ``width``. A stream's frames keep their receipt, with ``rank`` and ``source`` beside it, and are stepped the
    same way where their book is kept. Frames without a ticker are left out.
    """
    kind = F.when(F.col("type") == CHANNELS[0], "snapshot").when(F.col("type") == CHANNELS[1], "delta").when(F.col("type") == CHANNELS[2], "trade")
    rows = parsed.select(
        F.col("msg.market_ticker").alias("ticker"), seconds_to_ns(F.col("t_receipt")).alias("ord"), kind.alias("kind"), F.coalesce("conn_id", F.lit("")).alias("conn"), "sid", "seq",
        F.col("msg.side").alias("side"), dollars_to_cents(F.col("msg.price_dollars")).alias("price"), parse_size(F.col("msg.delta_fp")).alias("delta"), F.when(kind == "snapshot", F.concat(_levels("yes"), _levels("no"))).alias("levels"),
        F.col("channel_rank").alias("rank"), "source",
    ).where("ticker <> '' and kind is not null")
    if parsed.isStreaming:
        return rows
    counted = running(rows, ["ticker"], ["ord", "rank", "seq", "conn"], width, __n=("count", F.lit(1)))
    stepped = running(counted, ["ticker"], ["ord", "__n"], width, __ahead=("max", F.col("ord") - F.col("__n")))
    return stepped.withColumn("ord", F.col("__n") + F.col("__ahead")).drop("rank", "source", "__n", "__ahead")


def trade_events(parsed: DataFrame) -> DataFrame:
    """Trades that have ticker, price, count and taker; an empty ticker or taker counts as missing."""
    m = F.col("msg")
    rows = parsed.where(F.col("type") == "trade").select(seconds_to_ns(F.col("t_receipt")).alias("t_receipt_ns"), seconds_to_ns(parse_time(m["ts"])).alias("t_exchange_ns"), m["market_ticker"].alias("market_ticker"), m["taker_side"].alias("side"), dollars_to_cents(m["yes_price_dollars"]).alias("price"), parse_size(m["count_fp"]).cast("int").alias("size"), "sid", "seq")
    return rows.where("market_ticker <> '' and side <> '' and price is not null and size is not null")


def flat_deltas(parsed: DataFrame) -> DataFrame:
    m = F.col("msg")
    return parsed.where(F.col("type") == CHANNELS[1]).select(m["market_ticker"].alias("ticker"), "t_receipt", "seq", "sid", m["side"].alias("side"), m["price_dollars"].cast("double").alias("price"), m["delta_fp"].cast("double").alias("delta"))


def flat_trades(parsed: DataFrame) -> DataFrame:
    """Trades with a YES price; NO price and count are 0 where missing."""
    m = F.col("msg")
    count = F.coalesce(m["count_fp"], m["count"]).cast("double")
    return parsed.where((F.col("type") == "trade") & m["yes_price_dollars"].isNotNull()).select(m["market_ticker"].alias("ticker"), "t_receipt", "seq", m["taker_side"].alias("taker"), m["yes_price_dollars"].cast("double").alias("price"), F.coalesce(m["no_price_dollars"].cast("double"), F.lit(0.0)).alias("no_price"), F.coalesce(count, F.lit(0.0)).alias("size"))


def flat_snapshots(parsed: DataFrame) -> DataFrame:
    """Snapshots with both arrays: best bid and ask, spread, depth and level counts per side, and the books as JSON. A best NO bid of 0 counts as none."""
    m = F.col("msg")
    price = lambda s: F.array_max(F.transform(m[f"{s}_dollars_fp"], lambda x: x[0].cast("double")))
    total = lambda s: F.aggregate(F.transform(m[f"{s}_dollars_fp"], lambda x: x[1].cast("double")), F.lit(0.0), lambda a, x: a + x)
    ask = F.when(price("no") > 0, 1 - price("no"))
    rows = parsed.where((F.col("type") == CHANNELS[0]) & m["yes_dollars_fp"].isNotNull() & m["no_dollars_fp"].isNotNull())
    return rows.select(m["market_ticker"].alias("ticker"), "t_receipt", "seq", price("yes").alias("best_bid"), ask.alias("best_ask"), (ask - price("yes")).alias("spread"), *[x for s in ("yes", "no") for x in (total(s).alias(f"{s}_depth"), F.size(m[f"{s}_dollars_fp"]).alias(f"{s}_levels"), F.to_json(m[f"{s}_dollars_fp"]).alias(f"{s}_book"))])


def private_events(parsed: DataFrame) -> DataFrame:
    """Fills, orders, positions and lifecycle frames of an account: kind, ticker, order, side, price, count, status and position."""
    m = F.col("msg")
    kinds = ("fill", "user_order", "market_position", "market_lifecycle")
    return parsed.where(F.col("type").isin(*kinds)).select(F.col("type").alias("kind"), "t_receipt", m["market_ticker"].alias("ticker"), "msg.order_id", "msg.side", "msg.action", dollars_to_cents(m["yes_price_dollars"]).alias("price"), parse_size(F.coalesce(m["count_fp"], m["count"])).alias("count"), "msg.status", parse_size(m["position"]).alias("position"))
