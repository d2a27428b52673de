from __future__ import annotations

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from ticklake.operators import book
from ticklake.sources import frames, sinks
from ticklake.streaming import live


def line(kind, t, conn="c1", sid=1, seq=1, **msg):
    return json.dumps({"source": "feed", "channel": kind, "t_receipt": t, "conn_id": conn, "frame": {"type": kind, "sid": sid, "seq": seq, "msg": {"market_ticker": "A", **msg}}})


LINES = [
    line("orderbook_snapshot", 1.0, seq=1, yes_dollars_fp=[["0.5500", "100.00"]], no_dollars_fp=[["0.4000", "50.00"]]),
    line("orderbook_delta", 2.0, seq=2, price_dollars="0.5600", delta_fp="20.00", side="yes"),
    line("trade", 2.5, seq=3, yes_price_dollars="0.6000", count_fp="7.00", taker_side="yes", ts="2000"),
    "",
    line("orderbook_delta", 3.0, seq=4, price_dollars="0.6200", delta_fp="5.00", side="yes"),
    line("orderbook_delta", 4.0, seq=5, price_dollars="0.5000", delta_fp="5.00", side="yes"),
    line("orderbook_snapshot", 5.0, conn="c2", seq=1, yes_dollars_fp=[["0.3000", "10.00"]]),
]


def test_archive_is_read_in_order_and_books_follow(spark, tmp_path):
    for channel in frames.CHANNELS:
        folder = tmp_path / f"channel={channel}" / "date=2026-01-01"
        folder.mkdir(parents=True)
        with gzip.open(folder / "part.jsonl.gz", "wt") as f:
            f.write("\n".join(x for x in LINES if not x or f'"type": "{channel}"' in x))
    parsed = frames.read_date(spark, str(tmp_path), "2026-01-01")
    assert parsed.count() == 6
    assert frames.read_date(spark, str(tmp_path), "2026-01-02").count() == 0
    books = book.best(book.valid_books(book.depth(frames.to_book_frames(parsed)))).orderBy("ord").collect()
    assert [(r["bid"], r["ask"]) for r in books] == [(55, 60), (56, 60), (30, None)]
    trade = frames.trade_events(parsed).first()
    assert (trade["price"], trade["size"], trade["side"], trade["t_receipt_ns"]) == (60, 7, "yes", 2_500_000_000)
    assert frames.flat_snapshots(parsed).count() == 1


def test_stream_gives_the_same_books(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(LINES[:3]))
    (source / "b.jsonl").write_text("\n".join(LINES[3:]))
    os.utime(source / "a.jsonl", (1_700_000_000, 1_700_000_000))  # files are taken in order of their times
    events = live.books(live.read_frames(spark, str(source), 1))
    live.write(events, live.split_events(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect()
    assert [(r["event"], r["bid"], r["ask"]) for r in out] == [("book", 55, 60), ("book", 56, 60), ("invalidated", None, None), ("need_snapshot", None, None), ("book", 30, None)]


def test_event_time_bars_and_matches(spark):
    t = spark.createDataFrame([("A", 1, 0, 50, 5, "yes"), ("A", 2, 10, 60, 5, "yes"), ("A", 3, 40, 55, 5, "yes")], "ticker string, ord int, s int, price int, size int, side string").withColumn("ts", F.timestamp_seconds("s"))
    bars = live.bars(t).orderBy("window").collect()
    assert [(b["open"], b["high"], b["close"], b["n"]) for b in bars] == [(50, 60, 60, 2), (55, 55, 55, 1)]
    assert live.bursts(t, "15 seconds").count() == 2
    d = t.select("ticker", "ord", "ts", "price", "side", F.lit(-1).alias("delta"))
    assert live.matched(t, d).count() == 3


def test_sinks_rebuild_compact_and_register(spark, tmp_path):
    root = str(tmp_path / "TradeEvent")
    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("t_receipt_ns"), F.lit(1).cast("bigint").alias("t_exchange_ns"), F.lit("A").alias("market_ticker"), F.lit("yes").alias("side"), F.lit(50).alias("price"), F.lit(1).alias("size"), F.lit(1).alias("sid"), F.lit(1).alias("seq"))
    assert not sinks.has_date(spark, root, "2026-01-01")
    for date in ("2026-01-01", "2026-01-02", "2026-01-01"):
        sinks.write_events(rows, root, date)
    assert sinks.read_events(spark, root).count() == 200 and sinks.has_date(spark, root, "2026-01-02")
    assert [r["date"] for r in sinks.dates(spark, root).collect()] == ["2026-01-01", "2026-01-02"]
    done = sinks.compact(spark, root, "2026-01-01", str(tmp_path / "staging"), "2026-01-03").first()
    assert (done["input_files"], done["output_files"], done["total_rows"]) == (4, 1, 100)
    assert sinks.compact(spark, root, "2026-01-01", str(tmp_path / "staging"), "2026-01-03").first()["input_files"] == 1
    with pytest.raises(ValueError, match="over"):
        sinks.compact(spark, root, "2026-01-02", str(tmp_path / "staging"), "2026-01-02")
    sinks.register_functions(spark)
    assert spark.sql("SELECT dollars_to_cents('0.55'), maker_fee_cents(50)").first()[:] == (55, 1)


def test_raw_files_merge_without_parsing(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.txt").write_text("a\n\n b\n")
    sinks.merge_raw(spark.read.text(str(tmp_path / "raw")), str(tmp_path / "merged"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "merged")).collect()) == [" b", "a"]
