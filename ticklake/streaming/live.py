"""Streams of frames: books by keyed state, bars and volumes by event time, joins of trades and deltas.

A stream of frames is what ``sources.frames.to_book_frames`` makes of a streaming text source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ticklake.operators import book
from ticklake.sources import frames, sinks

EVENT = "ticker string, ord bigint, event string, seq bigint, sid bigint, bid int, bid_size bigint, ask int, ask_size bigint, " + ", ".join(f"{c} {book.kind_of(c)}" for c in book.DEPTH_COLUMNS)


def read_frames(spark: SparkSession, folder: str, files_per_batch: int = 100, bytes_per_batch: int | None = None) -> DataFrame:
    """Book frames of a folder of JSON-line files that keeps growing; a batch takes so many files, or about so many bytes of them."""
    return frames.to_book_frames(frames.parse(read_lines(spark, folder, files_per_batch, bytes_per_batch)))


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 100, bytes_per_batch: int | None = None) -> DataFrame:
    limit = ("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else ("maxFilesPerTrigger", files_per_batch)
    return spark.readStream.option(*limit).text(folder).where(F.trim("value") != "")


def archive(lines: DataFrame, root: str, checkpoint: str, every: str | None = None):
    """Keeps a stream's lines as they came, by channel, date and hour of receipt, before and apart from what is made of them:
    a query of its own on the same source, with its own checkpoint, so that neither waits for the other."""
    parsed = F.from_json("value", frames.FRAME)
    at = F.timestamp_seconds(F.coalesce(parsed["t_receipt"], F.lit(0.0)))
    placed = lines.select("value", F.coalesce(parsed["channel"], F.lit("unknown")).alias("channel"), F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH").alias("hour"))
    writer = placed.writeStream.format("text").partitionBy("channel", "date", "hour").option("compression", "gzip").option("path", root).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Books(StatefulProcessor):
    """Keeps one ticker's book as a vector of 99 YES and 99 NO sizes. Emits a ``book`` row of all depth columns after each
    change, ``invalidated`` when a delta crosses the book or the connection changed, and ``need_snapshot`` for deltas
    without a book. Frames apply in the order of receipt, channel and sequence number within a batch; each has an ord of its
    own, its receipt or one more than the last frame's. A ``lost`` row says that the connection is gone."""

    def __init__(self, least: int = 1, both_sides: bool = False):
        self.least, self.both_sides = least, both_sides

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("book", "conn string, sid bigint, open boolean, sizes array<bigint>, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ord", "rank", "seq", "conn"], kind="stable", na_position="first")
        conn, sid, open_, sizes, last = self.kept.get() if self.kept.exists() else (None, None, False, None, None)
        sizes = np.array(sizes if sizes is not None else [0] * 198, np.int64)
        events, states = [], []

        def emit(f, event):
            if event == "book" and self.both_sides and not (sizes[:99].any() and sizes[99:].any()):
                return
            events.append((key[0], at_ord, event, f.seq, f.sid))
            states.append(sizes.copy())

        for f in batch.itertuples():
            at_ord = int(f.ord) if last is None else max(int(f.ord), last + 1)
            last = last if f.kind == "lost" else at_ord
            if open_ and f.conn != conn:
                sizes[:], open_ = 0, False
                emit(f, "invalidated")
            if f.kind == "snapshot":
                sizes[:] = 0
                for x in f.levels:
                    sizes[_place(x["side"], x["price"])] = x["qty"] if x["qty"] >= self.least else 0
                conn, sid, open_ = f.conn, None if pd.isna(f.sid) else int(f.sid), True
                emit(f, "book")
            elif f.kind == "delta":
                if not open_:
                    emit(f, "need_snapshot")
                    continue
                if sid is not None and not pd.isna(f.sid) and int(f.sid) != sid:
                    continue
                at = _place(f.side, f.price)
                left = sizes[at] + int(f.delta)
                sizes[at] = left if left >= self.least else 0
                yes, no = np.flatnonzero(sizes[:99]), np.flatnonzero(sizes[99:])
                if len(yes) and len(no) and 99 - no[-1] < yes[-1] + 1:
                    sizes[:], open_ = 0, False
                    emit(f, "invalidated")
                else:
                    emit(f, "book")
        self.kept.update((conn, sid, open_, sizes.tolist(), last))
        out = pd.DataFrame(events, columns=["ticker", "ord", "event", "seq", "sid"]).astype({"seq": "Int64", "sid": "Int64"})
        depth = book.rows_of(np.array(states, np.int64).reshape(-1, 198))
        gone = (out["event"] != "book").to_numpy()
        whole = {c: pd.array(np.ma.filled(v, 0), "Int64") for c, v in depth.items()}
        for c, v in depth.items():
            whole[c][np.ma.getmaskarray(v) | gone] = pd.NA
        best = {"bid": whole["bid_1"], "bid_size": whole["bid_1_size"], "ask": whole["ask_1"], "ask_size": whole["ask_1_size"]}
        yield out.assign(**best, **{c: whole[c] for c in book.DEPTH_COLUMNS})

    def close(self) -> None:
        pass


def _place(side: str, price: int) -> int:
    return int(price) - 1 if side == "yes" else 98 + int(price)


class Connections(StatefulProcessor):
    """Knows a source's connection and the tickers seen on it; when another one starts, tells each of them that theirs is lost."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "conn string")
        self.known = handle.getMapState("known", "ticker string", "conn string")
        self.seen = handle.getMapState("seen", "conn string", "begins bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        current, lost = self.current.get()[0] if self.current.exists() else None, []
        for f in batch.itertuples():
            if f.conn != current and not self.seen.containsKey((f.conn,)):
                if current is not None:
                    lost += [(ticker, int(f.ord), f.conn) for (ticker,) in list(self.known.keys())]
                    self.known.clear()
                current = f.conn
                self.seen.updateValue((current,), (int(f.ord),))
            if f.conn == current:
                self.known.updateValue((f.ticker,), (current,))
        if current is not None:
            self.current.update((current,))
        yield pd.DataFrame(lost, columns=["ticker", "ord", "conn"]).assign(kind="lost", rank=-1)

    def close(self) -> None:
        pass


def _firsts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.groupby(["source", "conn", "ticker"], as_index=False)["ord"].min()


def connection_losses(stream: DataFrame) -> DataFrame:
    """A row for each ticker of a connection as soon as its source's next one starts: ticker, ord (of that start), conn (the new one),
    kind and rank. Tasks send a source's state one row a ticker and connection of theirs."""
    firsts = stream.select(F.coalesce("source", F.lit("")).alias("source"), "conn", "ticker", "ord").mapInPandas(_firsts, "source string, conn string, ticker string, ord bigint")
    return firsts.groupBy("source").transformWithStateInPandas(Connections(), "ticker string, ord bigint, conn string, kind string, rank int", "Append", "None")


def books(stream: DataFrame, least: int = 1, both_sides: bool = False, eager: bool = False) -> DataFrame:
    """Events of all tickers' books; ``least`` and ``both_sides`` give the profile with a minimum size and two-sided rows.

    A ticker's book on a connection that is gone is invalidated by the ticker's next frame of another connection, or, if
    ``eager``, as soon as any ticker of its source has one, also if the ticker never comes again.
    """
    rows = stream.where("kind in ('snapshot', 'delta')").select("ticker", "ord", "kind", "conn", "sid", "seq", "rank", "side", "price", "delta", "levels")
    if eager:
        rows = rows.unionByName(connection_losses(stream), allowMissingColumns=True)
    return rows.groupBy("ticker").transformWithStateInPandas(Books(least, both_sides), EVENT, "Append", "None")


def bars(trades: DataFrame, width: str = "30 seconds", delay: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Open, high, low, close and volume per ticker and window of event time ``ts``; with ``slide`` windows overlap."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    prices = [F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close")]
    return trades.withWatermark("ts", delay).groupBy("ticker", at).agg(*prices, F.sum("size").alias("volume"), F.count("*").alias("n"))


def bursts(trades: DataFrame, gap: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Sessions of a ticker's trades that a gap parts."""
    return trades.withWatermark("ts", delay).groupBy("ticker", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


def matched(trades: DataFrame, deltas: DataFrame, within: str = "2 seconds", delay: str = "1 minute") -> DataFrame:
    """Trades with the negative deltas at the level that they took, within ``within`` either way."""
    t = trades.withWatermark("ts", delay).alias("t")
    d = deltas.where("delta < 0").withWatermark("ts", delay).alias("d")
    near = F.expr(f"t.ticker = d.ticker and t.side = d.side and t.price = d.price and d.ts between t.ts - interval {within} and t.ts + interval {within}")
    return t.join(d, near).select("t.ticker", "t.ord", F.col("d.ord").alias("d_ord"), "t.side", "t.price", "t.size", "d.delta")


def without_repeats(rows: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def write(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Runs a sink per micro-batch, each ``every``, or over what is there and no more; restarts go on from the checkpoint."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def typed_events(parsed: DataFrame, **profile) -> DataFrame:
    """Events of a stream of parsed frames in one tagged table: those of ``books``, and ``trade`` rows (side, price, size and t_exchange_ns)."""
    own = books(frames.to_book_frames(parsed), **profile)
    trades = frames.trade_events(parsed).select(F.col("market_ticker").alias("ticker"), F.col("t_receipt_ns").alias("ord"), F.lit("trade").alias("event"), "seq", "sid", "t_exchange_ns", "side", "price", "size")
    return own.unionByName(trades, allowMissingColumns=True)


#: The event that a typed table's rows come of, and its columns that have other names there.
ROUTES = {
    "OrderBookUpdate": ("book", {"bid_yes": "bid", "ask_yes": "ask"}),
    "OrderBookDepth": ("book", {}),
    "BookInvalidated": ("invalidated", {}),
    "TradeEvent": ("trade", {}),
}


def route_events(root: str, version: int = sinks.VERSION) -> Callable[[DataFrame, int], None]:
    """A sink that writes ``typed_events`` to a table per type under ``root``, with the columns of ``sinks.TABLES``, by date, version and batch.

    A batch is first kept as it is, as each run of it would advance the books' state; then each table gets its rows. A
    batch that is written again replaces its own partitions. Updates are of books with both sides.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{root}/_batches/{number}"
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged).withColumnsRenamed({"ord": "t_receipt_ns", "ticker": "market_ticker"})
        day = F.date_format(F.timestamp_seconds(F.col("t_receipt_ns") / 1_000_000_000), "yyyy-MM-dd")
        for table, (event, names) in ROUTES.items():
            own = rows.where(F.col("event") == event)
            if table == "OrderBookUpdate":
                own = own.where("bid is not null and ask is not null")
            kinds = dict(c.split(" ") for c in sinks.TABLES[table].split(", "))
            columns = [F.col(names.get(c, c)).cast(k).alias(c) for c, k in kinds.items()]
            placed = own.select(*columns, day.alias("date"), F.lit(version).alias("v"), F.lit(number).alias("batch")).sortWithinPartitions("t_receipt_ns")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date", "v", "batch").parquet(f"{root}/{table}")

    return sink


def split_events(root: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each kind of event to a table of its own; a batch written again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event", "batch").parquet(root)

    return sink
