"""Joins with nulls and repeats, order of frames, gates, archives, sinks, the catalogue and depth rows of a stream."""

from __future__ import annotations

import gzip
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ticklake.operators import book, fills, joins, quality
from ticklake.sources import frames, games, sinks
from ticklake.streaming import live
from test_sources import LINES, line


def test_range_join_keeps_nulls_and_repeats(spark):
    left = spark.createDataFrame([("a", 10, None), ("a", 20, "x"), ("a", 20, "x"), (None, 5, "y"), ("b", 99, "z")], "k string, t int, note string")
    right = spark.createDataFrame([("a", 9, 1), ("a", 21, 2), ("a", 23, 3), (None, 5, 4), ("a", None, 5)], "k string, u int, v int")
    run = lambda how: sorted((tuple(r) for r in joins.range_join(left, right, ["k"], "t", "u", 3, 2, how).collect()), key=repr)
    pairs = [("a", 10, None, 9, 1), ("a", 20, "x", 21, 2), ("a", 20, "x", 21, 2)]
    assert run("inner") == sorted(pairs, key=repr)
    assert run("left") == sorted([*pairs, (None, 5, "y", None, None), ("b", 99, "z", None, None)], key=repr)
    assert run("left_semi") == sorted([p[:3] for p in pairs], key=repr)
    assert run("left_anti") == sorted([(None, 5, "y"), ("b", 99, "z")], key=repr)


def test_asof_in_ranges_equals_one_window(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice(["x", "y", None]), rng.choice([None, *range(300)]), i) for i in range(150)], "k string, t int, i int")
    right = spark.createDataFrame([(rng.choice(["x", "y", None]), rng.choice([None, *range(300)]), v) for v in range(60)], "k string, u int, v int")
    for exact in (True, False):
        for forward in (True, False):
            run = lambda **more: sorted((tuple(r) for r in joins.asof(left, right, ["k"], "t", "u", ["v"], exact, forward, **more).where("t is not null").collect()), key=repr)  # noqa: E731, B023
            assert run(width=7) == run() == run(width=1000)


def test_queue_fills_over_several_buckets(spark):
    orders = spark.createDataFrame([(1, "A", "buy", 50, 95, 205, 2, 5), (2, "A", "sell", 50, 0, 400, 0, 100), (3, "A", "buy", 50, 30, 20, 0, 5)], "order_id int, ticker string, side string, price int, placed long, until long, queue_ahead int, remaining int")
    trades = spark.createDataFrame([("A", 95, 50, 9, "no"), ("A", 101, 50, 4, "no"), ("A", 205, 50, 9, "no"), ("A", 206, 50, 9, "no"), ("A", 150, 50, 3, "yes"), ("A", 150, 51, 3, "no")], "ticker string, ord long, price int, size int, taker string")
    for width in (7, 100, 10_000):
        assert sorted(tuple(r) for r in fills.queue_fills(orders, trades, width).collect()) == [(1, "A", 101, 2), (1, "A", 205, 3), (2, "A", 150, 3)]


def test_frames_of_one_receipt_keep_channel_and_sequence(spark):
    rows = [line("orderbook_delta", 1776643200.25, seq=q, price_dollars="0.5000", delta_fp="1.00", side="yes") for q in (64, 63, 128, 62)]
    rows += [line("orderbook_snapshot", 1776643200.25, seq=900, yes_dollars_fp=[["0.5", "1"]]), line("trade", 1776643200.25, seq=1, market_ticker="")]
    got = frames.to_book_frames(frames.parse(spark.createDataFrame([(r,) for r in rows], "value string"))).orderBy("ord").collect()
    assert [(r["kind"], r["seq"]) for r in got] == [("snapshot", 900), ("delta", 62), ("delta", 63), ("delta", 64), ("delta", 128)]
    assert len({r["ord"] for r in got}) == 5


def test_empty_ticker_and_taker_make_no_trade(spark):
    rows = [line("trade", 1.0, yes_price_dollars="0.6", count_fp="7", **x) for x in ({"taker_side": "yes"}, {"taker_side": ""}, {"taker_side": "no", "market_ticker": ""}, {})]
    assert [r["side"] for r in frames.trade_events(frames.parse(spark.createDataFrame([(r,) for r in rows], "value string"))).collect()] == ["yes"]


def frame_rows(spark, rows):
    return spark.createDataFrame(rows, "ticker string, ord long, kind string, conn string, sid long, seq long, side string, price int, delta long, levels array<struct<side:string,price:int,qty:long>>")


def snapshot(o, levels, conn="c"):
    return ("A", o, "snapshot", conn, 1, o, None, None, None, levels)


def delta(o, side, price, by, conn="c"):
    return ("A", o, "delta", conn, 1, o, side, price, by, None)


def test_sizes_beyond_32_bits_history_and_samples(spark):
    big = 3_000_000_000
    df = frame_rows(spark, [snapshot(1, [("yes", 40, big)]), delta(2, "yes", 40, 5), delta(3, "no", 30, 7), delta(9, "yes", 40, -big - 5), delta(10, "no", 30, 1)])
    books = book.depth(df).orderBy("ord").collect()
    assert [r["bid_1_size"] for r in books] == [big, big + 5, big + 5, None, None]
    held = sorted(tuple(r)[2:] for r in book.history(df).collect())
    assert held == [(1, "yes", 40, big), (2, "yes", 40, big + 5), (3, "no", 30, 7), (3, "yes", 40, big + 5), (9, "no", 30, 7), (10, "no", 30, 8)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(r["ord"] for r in book.sampled(book.depth(df), 2).collect()) == [1, 3, 9]
        assert sorted(r["ord"] for r in book.sampled(book.depth(df), 1).collect()) == [1, 2, 3, 9, 10]
        rows = [snapshot(1, [("yes", 55, 60)]), delta(2, "yes", 55, -20), delta(3, "yes", 55, 55), delta(4, "yes", 55, 1), delta(5, "no", 20, 70)]
        assert {(r["side"], r["ord"]): r["qty"] for r in book.level_state_min_size(frame_rows(spark, rows), 50).collect()} == {("yes", 1): 60, ("yes", 2): 0, ("yes", 3): 55, ("yes", 4): 56, ("no", 5): 70}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("crossed", "out", "fails"), [(0, 500, None), (5, 500, None), (6, 500, "crossed_ok"), (0, 200, "trades_ok")])
def test_gate(spark, crossed, out, fails):
    nulls = [F.lit(None).cast("int").alias(c) for c in book.DEPTH_COLUMNS if c != "spread"]
    books = spark.range(100).select(F.when(F.col("id") < crossed, -1).otherwise(2).alias("spread"), *nulls)
    gate = quality.depth_gate(books, spark.range(500), spark.range(out))
    if fails:
        with pytest.raises(ValueError, match=fails):
            quality.require_gate(gate)
    else:
        quality.require_gate(gate)


def test_invariants_raise(spark):
    books = book.depth(frame_rows(spark, [snapshot(1, [("yes", 40, 5)])]))
    assert book.require_valid(books).count() == 1
    with pytest.raises(ValueError, match="negative_size"):
        book.require_valid(books.withColumn("bid_1_size", F.lit(-1).cast("bigint")))
    with pytest.raises(ValueError, match="price_outside"):
        book.require_valid(books.withColumn("bid_1", F.lit(0)))


def test_freshness(spark, tmp_path):
    out = str(tmp_path / "t")
    spark.range(0, 10, 1, 3).write.parquet(out)
    for k, name in enumerate(sorted(n for n in os.listdir(out) if n.endswith(".parquet"))):
        os.utime(os.path.join(out, name), (1_700_000_000 - 86_400 * k,) * 2)
    row = quality.freshness(spark.read.parquet(out), F.timestamp_seconds(F.lit(1_700_000_000 + 330))).first()
    assert (row["n_files"], row["n_today"], row["minutes_since"]) == (3, 1, 5)
    assert abs(time.time() - 1_700_000_000) > 0 and row["latest"].timestamp() == 1_700_000_000


def test_boxscores_and_dumps(spark, tmp_path):
    def game(i, day, score):
        folder = tmp_path / "box" / day
        folder.mkdir(parents=True, exist_ok=True)
        g = {"gameId": f"g{i}", "period": 1, "gameClock": "PT08M09.00S", "gameStatus": 2, "homeTeam": {"teamTricode": "DEN", "score": score}, "awayTeam": {"teamTricode": "MIN", "score": 3}}
        with gzip.open(folder / f"{i}.jsonl.gz", "at") as f:
            f.write(json.dumps({"t_receipt": float(i), "frame": {"game": g}}) + "\n\nnot json\n")

    game(1, "2026/04/20", 5)
    game(2, "2026/04/19", 7)
    game(3, "2026/04/18", 9)
    rows = games.read_boxscores(spark, str(tmp_path / "box"), "2026-04-20").orderBy("game_id").collect()
    assert [(r["game_id"], r["home_team"], r["away_score"], r["home_score"], r["seconds_left"]) for r in rows] == [("g1", "DEN", 3, 5, 2649), ("g2", "DEN", 3, 7, 2649)]
    assert games.read_boxscores(spark, str(tmp_path / "box"), "2026-05-20").count() == 0
    folder = tmp_path / "raw" / "feed" / "markets"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"markets": [{"ticker": "A", "volume": 3}, {"ticker": "B"}]}, indent=1))
    (folder / "b.json").write_text(json.dumps({"markets": []}))
    got = games.read_documents(spark, str(tmp_path / "raw"), "feed", "markets", "markets array<struct<ticker:string,volume:bigint>>", "markets").orderBy("ticker").collect()
    assert [(r["ticker"], r["volume"]) for r in got] == [("A", 3), ("B", None)] and got[0]["file"].endswith("a.json")
    assert games.read_documents(spark, str(tmp_path / "raw"), "feed", "markets", "markets array<struct<ticker:string>>").count() == 2


def test_flat_tables_history_and_catalogue(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in LINES if x], "value string")
    parsed = frames.parse(lines)
    for channel, n in (("orderbook_snapshot", 1), ("orderbook_delta", 3), ("trade", 1)):
        sinks.materialize(parsed, channel, str(tmp_path / channel))
        assert spark.read.parquet(str(tmp_path / channel)).count() == n
    lob, history = str(tmp_path / "lob"), book.history(frames.to_book_frames(parsed))
    for dt in ("2026-01-01", "2026-01-02", "2026-01-01"):
        sinks.write_dated(history, lob, dt, "ord")
    assert sinks.read_dated(spark, lob, ["2026-01-01"]).count() == history.count() and sinks.read_dated(spark, lob, ["2026-01-01", "2026-01-02"]).count() == 2 * history.count()
    assert len(sinks.TABLES) == 9
    depth = spark.range(2).select(*[F.lit(60 if c.endswith("_size") else 1).cast(t).alias(c) for c, t in (x.split() for x in sinks.TABLES["OrderBookDepth"].split(", "))])
    root = str(tmp_path / "OrderBookDepth")
    sinks.write_events(depth.withColumn("bid_1_size", F.when(F.monotonically_increasing_id() % 2 == 0, 10).otherwise(60).cast("int")), root, "2026-01-01")
    for name in ("OrderBookDepth", "dim_markets", "bbo"):
        spark.sql(f"DROP {'VIEW' if name == 'bbo' else 'TABLE'} IF EXISTS {name}")
    sinks.register(spark, "OrderBookDepth", root)
    sinks.register_markets(spark, "dim_markets", str(tmp_path / "markets"))
    sinks.bbo_view(spark, "bbo", "OrderBookDepth")
    assert spark.table("OrderBookDepth").count() == 2 and spark.table("bbo").count() <= 2 and len(spark.table("dim_markets").columns) == 16
    for name in ("OrderBookDepth", "dim_markets"):
        spark.sql(f"DROP TABLE {name}")
    sinks.register_functions(spark)
    row = spark.sql("SELECT norm_cdf(1D), norm_cdf(-9D), norm_cdf(0D), parse_game_clock(1, 'PT08M09.00S'), parse_game_clock(5, 'PT03M00.00S'), parse_game_clock(2, '')").first()
    assert abs(row[0] - 0.8413447460685429) < 1e-12 and row[1] < 1e-12 and row[2] == 0.5 and tuple(row)[3:] == (2649, 180, 1440)


def test_stream_archives_apart_and_gives_depth_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(LINES))
    live.archive(live.read_lines(spark, str(source)), str(tmp_path / "bronze"), str(tmp_path / "ck1")).awaitTermination()
    kept = spark.read.text(str(tmp_path / "bronze"))
    assert sorted(r["value"] for r in kept.collect()) == sorted(x for x in LINES if x)
    assert {r["channel"] for r in kept.select("channel").distinct().collect()} == set(frames.CHANNELS)
    live.write(live.books(live.read_frames(spark, str(source), bytes_per_batch=1_000_000)), live.split_events(str(tmp_path / "out")), str(tmp_path / "ck2")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).where("event = 'book'").orderBy("ord").collect()
    parsed = frames.parse(spark.createDataFrame([(x,) for x in LINES if x], "value string"))
    whole = book.valid_books(book.depth(frames.to_book_frames(parsed))).orderBy("ord").collect()
    assert [[r[c] for c in book.DEPTH_COLUMNS] for r in streamed] == [[r[c] for c in book.DEPTH_COLUMNS] for r in whole]
