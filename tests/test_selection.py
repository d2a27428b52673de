"""Quantiles, ranged windows, first hits, costs, tape differences and sketches against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklake.operators import cross, fills, model, quantiles, ranges, search
from ticklake.sources import markets

RNG = np.random.default_rng(1)
COLUMNS = {
    "even": RNG.random(20_000),
    "heavy": np.exp(RNG.normal(0, 20, 20_000)),
    "few": RNG.integers(0, 5, 20_000).astype(float),
    "one value": np.full(5_000, 7.0),
    "a value in half of the rows": np.where(RNG.random(20_000) < 0.5, 3.0, RNG.normal(0, 1, 20_000)),
    "one row": np.array([4.0]),
    "two rows": np.array([1.0, 2.0]),
    "negative": -np.exp(RNG.normal(0, 5, 9_999)),
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_quantiles_are_exact(spark, name):
    x, p = COLUMNS[name], [0, 0.05, 0.25, 0.5, 0.95, 0.99, 1]
    rows = spark.createDataFrame([*((float(a),) for a in x), (None,), (float("nan"),)], "x double")
    assert np.allclose(quantiles.quantiles(rows, "x", p, most=200, accuracy=200), np.quantile(x, p), rtol=1e-12)


def test_quantiles_with_infinite_values(spark):
    rows = spark.createDataFrame([(float("-inf"),), *((float(k),) for k in range(9)), (float("inf"),)], "x double")
    assert quantiles.quantiles(rows, "x", [0, 0.1, 0.45, 1], most=3, accuracy=5) == [float("-inf"), 0.0, 3.5, float("inf")]


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5, 1.0]) == [None, None]


def test_quantiles_read_few_rows_and_shuffle_none(spark, monkeypatch):
    read = []
    plain = quantiles._read
    monkeypatch.setattr(quantiles, "_read", lambda t, held: read.append(len(held)) or plain(t, held))
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("x"))
    got = quantiles.quantiles(rows, "x", [0.5, 0.9], most=1_000)
    assert np.allclose(got, np.quantile((np.arange(200_000) * 7919) % 200_003, [0.5, 0.9])) and max(read) <= 1_000


def test_sketches_add_up_within_their_error(spark):
    rows = spark.range(300_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 31 % 70_001).alias("who"))
    daily = quantiles.distinct_sketches(rows, ["day"], "who")
    united = quantiles.distinct_over(daily.withColumn("part", F.col("day") % 3), ["part"]).collect()
    exact = {r["part"]: r["n"] for r in rows.groupBy((F.col("day") % 3).alias("part")).agg(F.countDistinct("who").alias("n")).collect()}
    assert len(united) == 3 and all(abs(r["about"] - exact[r["part"]]) <= 4 * 1.04 / 128 * exact[r["part"]] and r["n"] == 100_000 for r in united)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(500), k, rng.randrange(9) if rng.random() < 0.9 else None) for k in range(800)]
    return spark.createDataFrame(rows, "t string, o bigint, k bigint, v bigint")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_equal_a_window(points, inclusive):
    got = ranges.running(points, ["t"], ["o", "k"], 37, inclusive, s=("sum", "v"), m=("max", "v"), c=("count", "v"), lo=("min", -F.col("v")))
    w = Window.partitionBy("t").orderBy("o", "k").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    same(got, points.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"), F.coalesce(F.count("v").over(w), F.lit(0)).alias("c"), F.min(-F.col("v")).over(w).alias("lo")))


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbours_equal_a_window(points, ahead):
    got = ranges.neighbour(points, ["t"], ["o", "k"], 37, ["k", "v"], "p", ahead).selectExpr("t", "o", "k", "v", "p.k as pk", "p.v as pv")
    f, w = F.lead if ahead else F.lag, Window.partitionBy("t").orderBy("o", "k")
    same(got, points.select("*", f("k").over(w).alias("pk"), f("v").over(w).alias("pv")))


def test_a_hot_key_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("t"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = ranges.running(rows, ["t"], ["o"], 500, n=("count", F.lit(1))).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 15_000


def test_first_hits_equal_a_scan(spark):
    rng = random.Random(3)
    series = [(rng.choice("xy"), rng.randrange(40_000), rng.gauss(50, 10)) for _ in range(1_500)] + [("x", 5, None), (None, 9, 1.0), ("x", None, 0.0), ("y", 7, 44.0), ("y", 7, 43.0)]
    asked = []
    for k in range(300):
        after = rng.randrange(-10, 40_000)
        asked.append((k, rng.choice("xyz"), after, after + rng.choice([0, 1, 30, 3_000, 60_000]), rng.choice([None, rng.gauss(25, 8)]), rng.choice([None, rng.gauss(75, 8)])))
    got = search.first_beyond(spark.createDataFrame(asked, "id bigint, t string, after bigint, until bigint, low double, high double"), spark.createDataFrame(series, "t string, o bigint, v double"), ["t"], "o", "v", width=10, levels=2, fanout=4)
    want = {}
    for k, t, after, until, low, high in asked:
        hits = [(o, v) for s, o, v in series if s == t and o is not None and v is not None and after < o <= until and ((low is not None and v <= low) or (high is not None and v >= high))]
        want[k] = min(hits, default=(None, None))
    assert {r["id"]: (r["hit"], r["hit_value"]) for r in got.collect()} == want and sum(h[0] is not None for h in want.values()) > 30


def cost_by_hand(rows):
    out, state = {}, {}
    for t, ord_, side, price, n in sorted(rows, key=lambda r: r[1]):
        pos, cost, entry = state.get(t, (0, 0.0, None))
        step, won = n if side == "buy" else -n, 0.0
        after = pos + step
        if pos * step < 0:
            won = min(abs(step), abs(pos)) * (price - entry) * (1 if pos > 0 else -1)
        if after == 0:
            cost, entry = 0.0, None
        elif pos * step >= 0:
            cost += price * step
            entry = abs(cost / after)
        elif abs(after) < abs(pos):
            cost *= after / pos
        state[t] = (after, cost, entry)
        out[t, ord_] = (after, round(cost, 6), entry and round(entry, 6), round(won, 6))
    return out


def test_average_cost_with_partial_closings_and_turns(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), k, rng.choice(["buy", "sell"]), rng.randrange(1, 100), rng.randrange(1, 6)) for k in range(600)]
    rows += [("d", 1, "buy", 40, 10), ("d", 2, "sell", 60, 4), ("d", 3, "buy", 52, 4), ("d", 4, "sell", 50, 10)]
    got = fills.average_cost(spark.createDataFrame(rows, "ticker string, ord bigint, side string, price int, n int"), width=50).collect()
    by = {(r["ticker"], r["ord"]): (r["after"], round(r["cost"], 6), r["entry"] and round(r["entry"], 6), round(r["realized"], 6)) for r in got}
    assert by == cost_by_hand(rows)
    assert [by["d", k][2:] for k in (1, 2, 3, 4)] == [(40.0, 0.0), (40.0, 80.0), (44.8, 0.0), (None, 52.0)]


def test_tapes_with_times_apart(spark):
    live = spark.createDataFrame([("A", 1, 50, 55), ("A", 10, 51, 55), ("A", 30, 51, 56), ("B", 5, 1, 2)], "ticker string, ord bigint, bid int, ask int")
    replay = spark.createDataFrame([("A", 2, 50, 55), ("A", 15, 51, 55), ("A", 30, 51, 56), ("C", 4, 1, 2), ("B", 5, 1, 2)], "ticker string, ord bigint, bid int, ask int")
    got = cross.tape_diff(live, replay, ["bid", "ask"], 7).orderBy("ticker", "ord").collect()
    assert [(r["ticker"], r["ord"], r["live"] and r["live"][:], r["replay"] and r["replay"][:], r["until"]) for r in got] == [("A", 1, (50, 55), None, 2), ("A", 10, (51, 55), (50, 55), 15), ("C", 4, None, (1, 2), None)]


def test_stops_of_both_sides(spark):
    quotes = spark.createDataFrame([("A", o, m) for o, m in ((1, 50.0), (5, 44.0), (9, 40.0), (12, 60.0), (20, 75.5))], "ticker string, ord bigint, mid double")
    held = [(1, "A", "long", 50, 1, None, 0.2), (2, "A", "long", 50, 1, 8, 0.2), (3, "A", "short", 50, 1, None, 0.5), (4, "A", "short", 100, 1, None, 0.1), (5, "A", "long", 0, 1, None, 0.0), (6, "B", "long", 50, 1, None, 0.1)]
    positions = spark.createDataFrame(held, "id int, ticker string, side string, entry int, opened bigint, closed bigint, share double")
    got = {r["id"]: (r["stop_at"], r["stop_mid"]) for r in model.stop_loss(positions, quotes, width=4).collect()}
    assert got == {1: (9, 40.0), 2: (None, None), 3: (20, 75.5), 4: (None, None), 5: (5, 44.0), 6: (None, None)}


def test_last_live_market_wins(spark):
    kind = "ticker string, result string, n int, at int"
    live = [("a", "", 1, 1), ("a", "yes", 2, 2), ("b", "no", 3, 1), ("b", "", 4, 2), ("c", "", 5, 1), ("e", None, 6, 1)]
    old = [("a", "no", 7, 1), ("b", "", 8, 1), ("b", "yes", 9, 2), ("b", "no", 10, 3), ("d", "", 11, 2), ("d", "", 12, 1), ("e", "", 13, 1)]
    for parts in (1, 5):
        got = markets.merge(spark.createDataFrame(live, kind).repartition(parts), spark.createDataFrame(old, kind).repartition(parts), "at")
        assert {r["ticker"]: (r["result"], r["n"]) for r in got.collect()} == {"a": ("yes", 2), "b": ("yes", 9), "c": ("", 5), "d": ("", 12), "e": (None, 6)}
    tied = [spark.createDataFrame([("a", "", k) for k in range(50)], "ticker string, result string, n int").repartition(p) for p in (1, 7)]
    assert {markets.merge(x, x.where("false")).first()["n"] for x in tied} == {49}
