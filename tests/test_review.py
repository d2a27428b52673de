"""What a review on larger tables found: joins that grow with the square of a ticker's rows, and sums and halves left to chance."""

from __future__ import annotations

import random

from ticklake.operators import fills, model, search


def most_joined(df):
    """The most rows that any join of the query put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name and node.metrics().get("numOutputRows").isDefined():
            most = max(most, node.metrics().get("numOutputRows").get().value())
    return most


def tape(spark, n, seed=1, step=5):
    rng = random.Random(seed)
    rows = [("A" if rng.random() < 0.8 else "B", rng.randrange(n * step), rng.choice([None, *range(40, 60)])) for _ in range(n)] + [("A", None, 50), (None, 7, 50)]
    return rows, spark.createDataFrame(rows, "ticker string, ord bigint, price int")


def test_pairs_by_horizon_meet_one_row_each(spark):
    rows, df = tape(spark, 1500)
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    none_first = lambda p: (p is not None, p)
    want = set()
    for t, o, p in set(known):
        for h in (1000, 3000):
            later = [(x, none_first(q)) for s, x, q in known if s == t and abs(x - o - h) * 10 < h]
            if later:
                x, (_, q) = min(later)
                want.add((t, h, o, None if None in (p, q) else q - p, (x - o) / 1e6))
    pairs = model.horizon_pairs(df, [1000, 3000], 1)
    assert {tuple(r) for r in pairs.collect()} == want and len(want) > 1500
    assert most_joined(pairs) < 10 * len(rows)


def test_trades_around_events_are_counted_not_paired(spark):
    rows, df = tape(spark, 1500)
    rng = random.Random(2)
    events = [(t, o) for t, o, _ in rows if rng.random() < 0.5] + [("A", 3000), ("A", 3000), ("C", 5), ("A", 90_000)]
    known, span, want = [r for r in rows if None not in r[:2]], 2000, {}
    none_first = lambda p: (p is not None, p or 0, p)
    for t, o in events:
        before = [(x, none_first(p)) for s, x, p in known if o is not None and s == t and o - span <= x < o]
        after = [(x, none_first(p)) for s, x, p in known if o is not None and s == t and o < x <= o + span]
        if before or after:
            times = events.count((t, o))
            want[t, o] = (len(before) * times, len(after) * times, max(before)[1][2] if before else None, min(after)[1][2] if after else None)
    found = model.around(spark.createDataFrame(events, "ticker string, ord bigint"), df, span)
    assert {(r["ticker"], r["ord"]): tuple(r)[2:] for r in found.collect()} == want and len(want) > 500
    assert most_joined(found) < 10 * len(rows)


def test_entry_of_a_reduced_position_at_half_a_cent(spark):
    rows, want = [], {}
    for p, q, second, cost, entry in ((77, 62, 5, 139.0, 70), (71, 60, 2, 327.5, 66), (27, 44, 2, 177.5, 36), (70, 73, 4, 214.5, 72)):
        t = f"{p}-{q}"
        rows += [(t, 1, "buy", p, 5), (t, 2, "buy", q, 5), (t, 3, "sell", 50, 3), (t, 4, "sell", 50, second)]
        want[t] = (7 - second, cost, entry)
    held = fills.open_costs(fills.average_cost(spark.createDataFrame(rows, "ticker string, ord bigint, side string, price int, n int"), width=2))
    assert {r["ticker"]: tuple(r)[1:] for r in held.collect()} == want


def test_front_running_reads_both_ends_of_its_time(spark):
    rng = random.Random(3)
    trades = [("A" if rng.random() < 0.8 else "B", o, rng.randrange(40, 60)) for o in rng.sample(range(8000), 1500)]
    changes = [(t, o, rng.randrange(9), rng.randrange(9)) for t, o, _ in trades if rng.random() < 0.5] + [("C", 7, 1, 2)]
    found = model.front_running(spark.createDataFrame(changes, "ticker string, ord bigint, diff int, before int"), spark.createDataFrame(trades, "ticker string, ord bigint, price int"), 2000, 200)
    want = {}
    for t, o, diff, before in changes:
        near = sorted((x, p) for s, x, p in trades if s == t and o - 2000 < x < o - 200)
        move = near[-1][1] - near[0][1] if near else 0
        want[t, o] = len(near) >= 2 and abs(move) >= 2 and (move > 0) - (move < 0) == (diff > before) - (diff < before)
    assert {(r["ticker"], r["ord"]): r["ahead"] for r in found.collect()} == want and 100 < sum(want.values()) < 700
    assert most_joined(found) < 10 * len(trades)


def test_caps_take_no_rows_of_their_own(spark):
    from ticklake.functions.game import win_probability
    from pyspark.sql import functions as F

    rng = random.Random(4)
    states = spark.createDataFrame([(rng.choice("AB"), o, rng.randrange(2), rng.randrange(1, 100) / 100, rng.randrange(-9, 10), rng.randrange(1, 2880)) for o in range(900)], "ticker string, ord bigint, won int, m double, lead int, secs int")
    caps = [1, 2, 4, 8, 1000, 2000, 3000, 4000, 5000]
    found = model.sensitivity(states, [0.1], [0.44], [2880], caps, 100)
    want = {}
    rows = states.withColumn("p", win_probability(F.col("lead"), F.col("secs").cast("double"), F.lit(0.44))).orderBy("ord").collect()
    for cap in caps:
        at, n, pnl = {"A": (0, 0), "B": (0, 0)}, 0, 0.0
        for r in rows:
            held, most = at[r["ticker"]]
            if abs(r["p"] - r["m"]) > 0.1 and most < cap:
                d = 1 if r["p"] > r["m"] else -1
                at[r["ticker"]] = (held + d, max(most, abs(held + d)))
                n, pnl = n + 1, pnl + d * (r["won"] - r["m"])
        want[cap] = (n, round(pnl, 5))
    assert {r["cap"]: (r["n"], round(r["pnl"], 5)) for r in found.collect()} == want and want[1][0] < want[8][0] < want[1000][0]
    assert most_joined(found) < 3 * len(rows)


def test_intervals_in_a_full_block_are_swept_not_joined(spark):
    rng = random.Random(5)
    series = [("A", rng.randrange(3000), float(rng.randrange(100))) for _ in range(1200)]
    asked = [(k, "A", rng.randrange(3000), rng.randrange(3500), float(rng.randrange(20)), float(rng.randrange(80, 110))) for k in range(600)]
    found = search.first_beyond(spark.createDataFrame(asked, "id int, t string, after bigint, until bigint, low double, high double"), spark.createDataFrame(series, "t string, o bigint, v double"), ["t"], "o", "v", width=1000, levels=1)
    text = found._jdf.queryExecution().toString()
    want = {k: min(((o, v) for _, o, v in series if a < o <= z and (v <= low or v >= high)), default=(None, None)) for k, _, a, z, low, high in asked}
    assert {r["id"]: (r["hit"], r["hit_value"]) for r in found.collect()} == want and sum(o is not None for o, _ in want.values()) > 200
    assert "MapInArrow" in text and most_joined(found) <= len(asked)
