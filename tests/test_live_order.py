"""Order, reconnects and typed tables of streams."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from ticklake.operators import book
from ticklake.sources import frames, sinks
from ticklake.streaming import live


def line(kind, t, ticker="A", conn="c1", sid=1, seq=1, source="feed", **msg):
    return json.dumps({"source": source, "channel": kind, "t_receipt": t, "conn_id": conn, "frame": {"type": kind, "sid": sid, "seq": seq, "msg": {"market_ticker": ticker, **msg}}})


def delta(t, seq, size, price="0.5000", side="yes", **more):
    return line("orderbook_delta", t, seq=seq, price_dollars=price, delta_fp=f"{size}.00", side=side, **more)


def snapshot(t, seq, **more):
    return line("orderbook_snapshot", t, seq=seq, yes_dollars_fp=[["0.3000", "50.00"]], no_dollars_fp=[["0.2000", "50.00"]], **more)


def streamed(spark, tmp_path, files, make, sink):
    source = tmp_path / "in"
    source.mkdir()
    for k, lines in enumerate(files):
        (source / f"{k}.jsonl").write_text("\n".join(lines))
        import os

        os.utime(source / f"{k}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))
    parsed = frames.parse(live.read_lines(spark, str(source), 1))
    live.write(make(parsed), sink, str(tmp_path / "ck")).awaitTermination()


def test_stream_equals_batch_for_equal_receipts(spark, tmp_path):
    rng = random.Random(1)
    files, seq = [], {t: 60 for t in "AB"}
    for part in range(2):
        lines = []
        for t in "AB":
            for k in range(3):
                at = 1_700_000_000.0 + part * 10 + k
                if k == 0:
                    lines.append(snapshot(at, seq[t], ticker=t))
                for _ in range(300 if k == 1 and t == "A" and not part else 4):  # more than lie between two receipts
                    seq[t] += 1
                    lines.append(delta(at, seq[t], rng.choice([-9, -4, 5, 7]), ticker=t, price=rng.choice(["0.3000", "0.3100"])))
        rng.shuffle(lines)
        files.append(lines)
    streamed(spark, tmp_path, files, lambda parsed: live.books(frames.to_book_frames(parsed)), live.split_events(str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).where("event = 'book'").select("ticker", "ord", "bid", "bid_size", "ask").collect()
    lines = spark.createDataFrame([(x,) for part in files for x in part], "value string")
    batch = frames.to_book_frames(frames.parse(lines))
    want = book.best(book.depth(batch)).select("ticker", "ord", "bid", "bid_size", "ask").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == sum(map(len, files))
    assert batch.select("ticker", "ord").distinct().count() == batch.count()


def test_sequence_numbers_beyond_63_stay_in_order(spark):
    lines = spark.createDataFrame([(delta(5.0, s, -1),) for s in (64, 63, 128, 127)], "value string")
    rows = frames.to_book_frames(frames.parse(lines)).orderBy("ord").collect()
    assert [r["seq"] for r in rows] == [63, 64, 127, 128]


def test_eager_reconnect_reaches_a_ticker_that_never_comes_again(spark, tmp_path):
    files = [[snapshot(1.0, 1, ticker=t) for t in "ABC"] + [snapshot(1.0, 1, ticker="D", source="other")], [delta(2.0, 2, 5, ticker="A")], [snapshot(3.0, 1, ticker="A", conn="c2"), delta(3.5, 9, 1, ticker="B", conn="c1")], [delta(4.0, 2, 5, ticker="A", conn="c2")]]
    streamed(spark, tmp_path, files, lambda parsed: live.books(frames.to_book_frames(parsed), eager=True), live.split_events(str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out"))
    lost = sorted((r["ticker"], r["ord"]) for r in got.where("event = 'invalidated'").collect())
    assert lost == [(t, 3_000_000_000) for t in "ABC"]  # of the source whose connection changed
    assert [(r["event"], r["ord"]) for r in got.where("ticker = 'A'").orderBy("ord", F.desc("event")).collect()] == [("book", 10**9), ("book", 2 * 10**9), ("invalidated", 3 * 10**9), ("book", 3 * 10**9), ("book", 4 * 10**9)]
    assert [r["event"] for r in got.where("ticker = 'B'").orderBy("ord").collect()] == ["book", "invalidated", "need_snapshot"]


def test_typed_tables_of_one_stream(spark, tmp_path):
    files = [
        [snapshot(1.0, 1), delta(2.0, 2, 7), line("trade", 2.5, seq=3, yes_price_dollars="0.6000", count_fp="7.00", taker_side="yes", ts="2000"), line("trade", 2.6, seq=3, count_fp="7.00", taker_side="yes")],
        [delta(3.0, 4, 5, price="0.9000"), line("orderbook_snapshot", 4.0, seq=5, yes_dollars_fp=[["0.4000", "10.00"]])],
    ]
    root, kept = str(tmp_path / "tables"), []
    sink = live.route_events(root)

    def twice(batch, number):  # a batch that is written again
        kept.append(number)
        sink(batch, number)
        again = spark.read.schema(batch.schema).parquet(f"{root}/_batches/{number}")
        rows = spark.createDataFrame(again.collect(), batch.schema)
        sink(rows, number)

    streamed(spark, tmp_path, files, live.typed_events, twice)
    tables = {name: sinks.read_events(spark, f"{root}/{name}").orderBy("t_receipt_ns").collect() for name in live.ROUTES}
    assert [(r["bid_yes"], r["ask_yes"], r["seq"], r["sid"]) for r in tables["OrderBookUpdate"]] == [(30, 80, 1, 1), (50, 80, 2, 1)]
    assert [(r["t_receipt_ns"], r["bid_1"], r["ask_1"], r["spread"]) for r in tables["OrderBookDepth"]] == [(10**9, 30, 80, 50), (2 * 10**9, 50, 80, 30), (4 * 10**9, 40, None, None)]
    assert [r["t_receipt_ns"] for r in tables["BookInvalidated"]] == [3 * 10**9]
    assert [(r["price"], r["size"], r["side"], r["t_exchange_ns"]) for r in tables["TradeEvent"]] == [(60, 7, "yes", 2000 * 10**9)]
    for name, rows in tables.items():
        assert list(rows[0].asDict())[: len(sinks.TABLES[name].split(", "))] == [c.split(" ")[0] for c in sinks.TABLES[name].split(", ")]
    assert len(kept) == 2
