from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ticklake.functions import game, money
from ticklake.operators import book, fills, joins, tape

FRAME = "ticker string, ord bigint, kind string, conn string, sid bigint, seq bigint, side string, price int, delta bigint, levels array<struct<side:string,price:int,qty:bigint>>"


def snapshot(o, levels, ticker="A", conn="c1", sid=1):
    return (ticker, o, "snapshot", conn, sid, o, None, None, None, levels)


def delta(o, side, price, change, ticker="A", conn="c1", sid=1):
    return (ticker, o, "delta", conn, sid, o, side, price, change, None)


def frames(spark, rows):
    return spark.createDataFrame(rows, FRAME)


def fold(rows, least=1):
    """The books after each frame, frame by frame."""
    out, books = {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        key = (r[0], r[3])
        if r[2] == "snapshot":
            books[key] = {(s, p): q for s, p, q in r[9] if q > 0}
        elif key in books:
            at = (r[6], r[7])
            books[key][at] = max(0, books[key].get(at, 0) + r[8])
        else:
            continue
        live = {k: q for k, q in books[key].items() if q >= least}
        bid = max((p for (s, p) in live if s == "yes"), default=None)
        no = max((p for (s, p) in live if s == "no"), default=None)
        out[r[1]] = (bid, None if no is None else 100 - no)
    return out


def test_books_equal_a_fold_over_random_frames(spark):
    rng = random.Random(1)
    rows, o = [], 0
    for _ in range(300):
        o += 1
        if rng.random() < 0.05 or o == 1:
            rows.append(snapshot(o, [(s, rng.randint(1, 49), rng.randint(0, 30)) for s in ("yes", "no") for _ in range(4)]))
        else:
            rows.append(delta(o, rng.choice(["yes", "no"]), rng.randint(1, 49), rng.randint(-25, 25)))
    rows = [r if r[2] == "delta" else (*r[:9], list({(s, p): (s, p, q) for s, p, q in r[9]}.values())) for r in rows]
    for most in ("10000", "7"):  # the second cuts epochs and events over batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        got = {r["ord"]: (r["bid"], r["ask"]) for r in book.best(book.depth(frames(spark, rows))).collect()}
        assert got == fold(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states = book.level_state(frames(spark, rows)).where("qty < 0").count()
    assert states == 0


def test_cross_drops_rows_until_the_next_snapshot(spark):
    rows = [snapshot(1, [("yes", 55, 100), ("no", 44, 100)]), delta(2, "yes", 57, 50), delta(3, "yes", 50, 5), snapshot(4, [("yes", 40, 10), ("no", 40, 10)])]
    books = book.depth(frames(spark, rows))
    assert [r["ord"] for r in book.crosses(books).collect()] == [2]
    assert sorted(r["ord"] for r in book.valid_books(books).collect()) == [1, 4]


def test_deltas_without_snapshot_or_of_another_subscription_are_dropped(spark):
    rows = [delta(1, "yes", 50, 5), snapshot(2, [("yes", 40, 10)], sid=2), delta(3, "yes", 41, 5, sid=1), delta(4, "yes", 42, 5, sid=None)]
    df = frames(spark, rows)
    assert {(r["ord"], r["reason"]) for r in book.stale_deltas(df).collect()} == {(1, "no_snapshot"), (3, "other_subscription")}
    assert [r["ord"] for r in book.live_deltas(df).collect()] == [4]


def test_depth_has_all_columns_and_empty_books(spark):
    row = book.depth(frames(spark, [snapshot(1, [])])).first()
    assert row["bid_1"] is None and row["spread"] is None and row["num_bid_levels"] == 0 and row["bid_depth_5c"] == 0
    assert set(book.DEPTH_COLUMNS) <= set(row.asDict())
    assert book.depth(frames(spark, [])).count() == 0


def test_boundary_drift_and_minimum_size(spark):
    rows = [snapshot(1, [("yes", 55, 100), ("no", 44, 150)]), delta(2, "yes", 55, 10), snapshot(3, [("yes", 55, 111), ("no", 44, 150)])]
    drift = [tuple(r) for r in book.boundary_drift(frames(spark, rows)).collect()]
    assert drift == [("A", 1, 3, "yes", 55, 110, 111)]
    rows = [snapshot(1, [("yes", 55, 60)]), delta(2, "yes", 55, -20), delta(3, "yes", 55, 55)]
    sizes = {r["ord"]: r["qty"] for r in book.level_state_min_size(frames(spark, rows), 50).collect()}
    assert sizes == {1: 60, 2: 0, 3: 55}


def test_asof_and_range_joins_equal_brute_force(spark):
    rng = random.Random(2)
    a = [(rng.choice("xy"), rng.randint(0, 300), i) for i in range(120)]
    b = [(rng.choice("xy"), t, 1000 + t) for t in rng.sample(range(300), 60)]
    left, right = spark.createDataFrame(a, "k string, t int, i int"), spark.createDataFrame(b, "k string, u int, v int")
    for exact in (True, False):
        got = {r["i"]: r["v"] for r in joins.asof(left, right, ["k"], "t", "u", ["v"], exact=exact).collect()}
        assert got == {i: max(((u, v) for k2, u, v in b if k2 == k and (u <= t if exact else u < t)), default=(0, None))[1] for k, t, i in a}
    got = sorted((r["i"], r["v"]) for r in joins.range_join(left, right, ["k"], "t", "u", 7, 3).collect())
    assert got == sorted((i, v) for k, t, i in a for k2, u, v in b if k == k2 and t - 7 <= u <= t + 3)
    near = {r["i"]: r["v"] for r in joins.asof_nearest(left, right, ["k"], "t", "u", ["v"], F.lit(5)).collect()}
    for k, t, i in a:
        best = min(((abs(u - t), u > t, v) for k2, u, v in b if k2 == k), default=(99, 0, None))
        assert near[i] == (best[2] if best[0] <= 5 else None)
    sums = joins.running_sum(spark.range(0, 5000).selectExpr("id", "id % 7 as x"), "id", "x", "total", 64)
    assert sums.where("id = 4999").first()["total"] == sum(i % 7 for i in range(5000))


def test_round_trips_are_first_in_first_out(spark):
    rng = random.Random(3)
    rows = [("T", o, rng.choice(["buy", "sell"]), rng.randint(10, 90), 1) for o in range(80)]
    df = spark.createDataFrame(rows, "ticker string, ord int, side string, price int, n int")
    queue = {s: [r for r in rows if r[2] == s] for s in ("buy", "sell")}
    pairs = list(zip(queue["buy"], queue["sell"], strict=False))
    assert {(r["buy_ord"], r["sell_ord"]) for r in fills.round_trips(df).collect()} == {(x[1], y[1]) for x, y in pairs}
    assert fills.unpaired(df).count() == abs(len(queue["buy"]) - len(queue["sell"]))


@pytest.mark.parametrize(("period", "clock", "left"), [(1, "PT08M09.00S", 2649), (1, "PT12M00.00S", 2880), (4, "PT00M00.00S", 0), (3, "PT05M30.00S", 1050), (5, "PT03M00.00S", 180), (2, "", 1440), (5, "", 0)])
def test_clock(spark, period, clock, left):
    assert spark.range(1).select(game.clock_seconds(F.lit(period), F.lit(clock))).first()[0] == left


def test_tickers_probabilities_and_money(spark):
    rows = ["KXNBAGAME-26APR20MINDEN-MIN", "KXNBASPREAD-26APR20MINDEN-DEN7", "KXNBATOTAL-26APR20MINDEN-239", "KXNBAPTS-26APR25OKCPHX-PHXDBROOKS3-25", "SOMETHINGELSE-FOO-BAR"]
    p = [r["p"] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(game.parse_ticker(F.col("t")).alias("p")).collect()]
    assert [x["series"] for x in p] == ["GAME", "SPREAD", "TOTAL", "PTS", "UNKNOWN"]
    assert (p[1]["selection"], p[1]["threshold"], p[3]["selection"], p[3]["threshold"], str(p[0]["game_date"])) == ("DEN", 7, "PHXDBROOKS3", 25, "2026-04-20")
    r = spark.range(1).select(game.normal_cdf(F.lit(1.0)), game.win_probability(F.lit(0), F.lit(0.0)), money.dollars_to_cents(F.lit("0.125")), game.parse_time(F.lit("1700000000000")), game.parse_time(F.lit("x"))).first()
    assert abs(r[0] - 0.8413447) < 1e-6 and r[1] == 0.5 and r[2] == 12 and r[3] == 1.7e9 and r[4] is None


def test_bootstrap_doesnt_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("id", "id % 10 as x")
    a, b = (tape.bootstrap_mean(rows.repartition(n), "id", "x", 50).first() for n in (1, 7))
    assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True)) and a["low"] < 4.5 < a["high"]
