"""Exact quantiles of whole tables by distributed selection, and counts of distinct values that add up.

A quantile needs one or two ranks of the sorted column. A sketch of fixed size, which tasks make for themselves and Spark
merges, gives an interval about each rank; a count of the rows below and inside proves it, and the next round looks inside
it only. Once an interval holds few rows, or one value, these are read. No task and not the driver holds more than that,
and no row is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.operators.kept import kept

#: Rows of all intervals together that are read at the end.
MOST = 20_000


class _Target:
    """The ranks of one quantile, the interval of values known to hold them, and the rows below and inside it."""

    def __init__(self, p: float, n: int, low: float, high: float):
        place = p * (n - 1)
        self.first, self.last, self.part = math.floor(place), math.ceil(place), place - math.floor(place)
        self.low, self.high, self.below, self.inside = low, high, 0, n

    @property
    def done(self) -> bool:
        return self.low == self.high

    def narrowed(self, low: float, high: float, below: int, upto: int) -> None:
        if below <= self.first and self.last < upto and (low > self.low or high < self.high):
            self.low, self.high, self.below, self.inside = low, high, below, upto - below


def quantiles(rows: DataFrame, column: str | Column, probabilities: list[float], most: int = MOST, accuracy: int = 10_000) -> list[float | None]:
    """The quantiles of a numeric column, as ``percentile`` defines them: interpolated between the two nearest ranks.

    Nulls and NaN don't count; a column without numbers has nulls; a value may stand in any number of rows. Numbers are
    compared as doubles. Runs its jobs when called: one to keep the column, two a round, one to read what is left.
    """
    x = F.col(column) if isinstance(column, str) else column
    values = kept(rows.select(x.cast("double").alias("v")).where("v is not null and not isnan(v)"), "column")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(probabilities)
    targets = {p: _Target(p, n, low, high) for p in probabilities}
    v = F.col("v")
    while sum(t.inside for t in targets.values() if not t.done) > most:
        wide = [t for t in targets.values() if not t.done]
        asked = []
        for t in wide:  # a bracket of ranks about the two wanted ones, twice as wide as the sketch errs
            slack = 2 * t.inside / accuracy + 1
            at = [min(1.0, max(0.0, r / t.inside)) for r in (t.first - t.below - slack, t.last - t.below + slack)]
            asked.append(F.percentile_approx(F.when(v.between(t.low, t.high), v), F.array(*map(F.lit, at)), F.lit(accuracy)))
        brackets = values.agg(*asked).first()
        counts = values.agg(*[c for low, high in brackets for c in (F.count_if(v < low), F.count_if(v <= high))]).first()
        before = [t.inside for t in wide]
        for k, t in enumerate(wide):
            t.narrowed(*brackets[k], counts[2 * k], counts[2 * k + 1])
        if before == [t.inside for t in wide]:
            break  # intervals can't be told apart by the sketch any more: they hold few different values
    open_ = [t for t in targets.values() if not t.done]
    held = {}
    if open_:
        near = values.where(reduce(or_, [v.between(t.low, t.high) for t in open_]))
        held = {r["v"]: r["n"] for r in near.groupBy("v").agg(F.count("*").alias("n")).collect()}
    return [_read(targets[p], held) for p in probabilities]


def _read(t: _Target, held: dict[float, int]) -> float:
    if t.done:
        return t.low
    at, found = t.below, []
    for value in sorted(x for x in held if t.low <= x <= t.high):
        at += held[value]
        while len(found) < 2 and (t.first, t.last)[len(found)] < at:
            found.append(value)
    return found[0] + (found[1] - found[0]) * t.part if t.part else found[0]


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, bits: int = 14) -> DataFrame:
    """Per group a count, and a sketch of the values that can be united with others': a relative error of about 1.04 / 2^(bits / 2)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def distinct_over(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and estimated distinct values of united sketches: ``n`` and ``about`` per ``keys``; no row of the table is read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
