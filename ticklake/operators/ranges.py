"""Running values and neighbours along a key's order, worked in ranges of it.

A window over a key's whole history is one task's work. Here the order is cut into ranges; each range works for itself on
top of what the ranges before it carry over, of which there is one row a key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregates that a range hands on, and how the carried value and the range's own meet.
KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def _joined(dealt: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    own = carried.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__of"), *[c for c in carried.columns if c not in (*keys, "__range")])
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return dealt.join(own, same, "left").drop("__of", *[f"__{k}" for k in keys])


def _range(order: str, width: int) -> Column:
    return F.coalesce(F.floor(F.col(order) / width).cast("bigint"), F.lit(0))


def running(rows: DataFrame, keys: list[str], order: list[str], width: int, inclusive: bool = True, **out: tuple[str, str | Column]) -> DataFrame:
    """``rows`` with running values: each of ``out`` names an aggregate of ``KINDS`` and what it runs over, a column or an expression.

    Rows of a key run along ``order``, the first of which is a number that is cut into ranges of ``width``. Not
    ``inclusive``, a row's value is that before it. Rows that ``order`` can't tell apart stand in any order. Sums and counts
    start at 0; a maximum or minimum of nothing is null.
    """
    dealt = rows.withColumn("__range", _range(order[0], width))
    columns = {name: F.col(c) if isinstance(c, str) else c for name, (_, c) in out.items()}
    totals = dealt.groupBy(*keys, "__range").agg(*[KINDS[kind][0](columns[name]).alias(name) for name, (kind, _) in out.items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    kind_of = {name: "sum" if kind == "count" else kind for name, (kind, _) in out.items()}
    carried = totals.select(*keys, "__range", *[KINDS[kind_of[name]][0](name).over(before).alias(f"__c_{name}") for name in out])
    w = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    met = _joined(dealt, carried, keys)
    values = {name: KINDS[kind][1](F.col(f"__c_{name}"), KINDS[kind][0](columns[name]).over(w)) for name, (kind, _) in out.items()}
    return met.select(*rows.columns, *[c.alias(name) for name, c in values.items()])


def neighbour(rows: DataFrame, keys: list[str], order: list[str], width: int, columns: list[str], out: str, ahead: bool = False) -> DataFrame:
    """``rows`` with ``out``, a struct of ``columns`` of the row before (``ahead``: after) it under the keys; null for the first."""
    dealt = rows.withColumn("__range", _range(order[0], width))
    value, at = F.struct(*columns), F.struct(*order)
    w, over = Window.partitionBy(*keys, "__range").orderBy(*order), Window.partitionBy(*keys).orderBy("__range")
    edge = dealt.groupBy(*keys, "__range").agg((F.min_by(value, at) if ahead else F.max_by(value, at)).alias("__edge"))
    carried = edge.withColumn("__carried", (F.lead if ahead else F.lag)("__edge").over(over)).drop("__edge")
    own = (F.lead if ahead else F.lag)(value).over(w)
    return _joined(dealt.withColumn("__own", own), carried, keys).select(*rows.columns, F.coalesce("__own", "__carried").alias(out))
