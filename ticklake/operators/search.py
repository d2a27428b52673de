"""The first value of a series that passes a bound, for intervals and bounds of their own.

Blocks of a series' order hold its least and greatest value, and blocks of blocks theirs. An interval is first sought in
the block in which it begins. If nothing is found there, the rest is covered by few whole blocks of all sizes, and the
first of them that holds a hit is opened block by block down to one. Inside a block intervals and rows are swept from its
end, so an interval meets some ``fanout`` rows a level, however long it is, however late its hit and however full a block.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.operators.kept import kept


def _hit(low: Column, high: Column) -> Column:
    return F.coalesce(low <= F.col("low"), F.lit(False)) | F.coalesce(high >= F.col("high"), F.lit(False))


def _placed(blocks: Column, level: int, size: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block"), (b * size).alias("start")))


def _cover(levels: int, width: int, fanout: int) -> Column:
    """Blocks (level, block, start) that together are the whole finest blocks between the columns ``__a`` and ``__z``, the latter not included."""
    a, z, parts = F.col("__a"), F.col("__z"), []
    for level in range(levels + 1):
        up_a, up_z = F.ceil(a / fanout).cast("bigint"), F.floor(z / fanout).cast("bigint")
        whole = F.lit(level == levels) | (up_a >= up_z)
        blocks = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
        own = F.when(whole, blocks(a, z)).otherwise(F.concat(blocks(a, up_a * fanout), blocks(up_z * fanout, z)))
        parts.append(_placed(own, level, width * fanout**level))
        a, z = F.when(whole, F.lit(0).cast("bigint")).otherwise(up_a), F.when(whole, F.lit(0).cast("bigint")).otherwise(up_z)
    return F.concat(*parts)


def _sweep(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds hit and hit_value to intervals that are sorted with the rows of their block, latest first, an interval before rows of its own order.

    Columns: ``n`` of the block, order, value (null for an interval), low, high, and what intervals carry. Of the rows so
    far only those stay that are lower, or higher, than all nearer ones: the first beyond a bound is found among them by halving.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, low_keys, lows, high_keys, highs = None, [], [], [], []
        for batch in batches:
            asks, hits, values = [], [], []
            for *at, o, v, low, high in zip(*[batch.column(k).to_pylist() for k in range(n + 4)], strict=True):
                if at != group:
                    group, low_keys, lows, high_keys, highs = at, [], [], [], []
                asks.append(v is None)
                if v is None:
                    found = []
                    if low is not None and (k := bisect_right(low_keys, math.inf if low != low else low)):
                        found.append(lows[k - 1])
                    if high is not None and (k := bisect_right(high_keys, -math.inf if high != high else -high)):
                        found.append(highs[k - 1])
                    hit, value = min(found, default=(None, None))
                    hits.append(hit)
                    values.append(value)
                    continue
                for key, keys, kept_ in ((math.inf if v != v else v, low_keys, lows), (-math.inf if v != v else -v, high_keys, highs)):
                    while keys and keys[-1] >= key:
                        keys.pop()
                        kept_.pop()
                    keys.append(key)
                    kept_.append((o, v))
            rest = batch.filter(pa.array(asks))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(hits, pa.int64()), pa.array(values, pa.float64())], [*rest.schema.names, "hit", "hit_value"])

    return run


def first_beyond(intervals: DataFrame, series: DataFrame, keys: list[str], order: str, value: str, width: int, levels: int = 3, fanout: int = 16) -> DataFrame:
    """``intervals`` with ``hit``, the order of the first row of ``series`` at which ``value`` is at ``low`` or under, or at ``high`` or over, and ``hit_value``.

    Intervals have ``id``, the keys, ``after`` and ``until`` (a row counts if after < order <= until) and the bounds, of
    which null ones don't count. Without a hit both are null. ``width`` is the finest block's; a block of the top level is
    ``width * fanout ** levels`` long, and longer intervals take more than ``fanout`` of these. Of rows with one order the
    least value is taken. Repeated ids aren't told apart; null keys, orders and values are no hits. Blocks may hold any
    number of rows, which are sorted with the intervals that look into them.
    """
    points = series.select(*keys, F.col(order).cast("bigint").alias("__o"), F.col(value).alias("__v"), F.floor(F.col(order) / width).cast("bigint").alias("block")).where("__o is not null and __v is not null")
    points = kept(points, "points")
    extremes, found = [], points.groupBy(*keys, "block").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    for level in range(levels + 1):
        extremes.append(found.withColumn("level", F.lit(level)))
        found = found.groupBy(*keys, F.floor(F.col("block") / fanout).cast("bigint").alias("block")).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    every = extremes[0]
    for one in extremes[1:]:
        every = every.unionByName(one)
    every = kept(every, "extremes")
    block = lambda c: F.floor(F.col(c) / width).cast("bigint")
    carried = ["id", *keys, "after", "until", "low", "high"]
    asked = intervals.select("id", *keys, F.col("after").cast("bigint"), F.col("until").cast("bigint"), F.col("low").cast("double"), F.col("high").cast("double"))
    asked = asked.where(" and ".join(f"`{c}` is not null" for c in (*keys, "after", "until")))

    def within(rows: DataFrame, start: Column) -> DataFrame:
        """Intervals with the first hit in their ``block`` after ``start``."""
        own = rows.select(*keys, "block", start.alias("__o"), F.lit(None).cast("double").alias("__v"), F.col("low"), F.col("high"), "id", "after", "until")
        both = own.unionByName(points.select(*keys, "block", "__o", F.col("__v").cast("double")), allowMissingColumns=True)
        ordered = both.repartition(*keys, "block").sortWithinPartitions(*keys, "block", F.col("__o").desc(), F.col("__v").desc_nulls_first())
        return ordered.mapInArrow(_sweep(len(keys) + 1), own.schema.add("hit", "long").add("hit_value", "double")).select(*carried, "hit", "hit_value")

    def first(rows: DataFrame) -> DataFrame:
        """Of each interval's blocks that hold a hit the first."""
        hits = rows.join(every, [*keys, "level", "block"]).where(_hit(F.col("__lo"), F.col("__hi")))
        return hits.groupBy(*carried).agg(F.min(F.struct("start", "level", "block")).alias("b")).select(*carried, "b.*")

    near = kept(within(asked.where("until > after").withColumn("block", block("after")), F.col("after")), "near")  # in the block where the interval begins
    left = near.where("hit is null").withColumns({"__a": block("after") + 1, "__z": block("until") + 1}).where("__a < __z").drop("hit", "hit_value")
    whole = kept(first(left.select(*carried, F.explode(_cover(levels, width, fanout)).alias("b")).select(*carried, "b.*")), "opened")
    for level in range(levels, 0, -1):
        size = width * fanout ** (level - 1)
        child = whole.where(F.col("level") == level).withColumn("block", F.explode(F.sequence(F.col("block") * fanout, (F.col("block") + 1) * fanout - 1)))
        opened = first(child.withColumns({"level": F.lit(level - 1), "start": F.col("block") * size}))
        whole = kept(whole.where(F.col("level") < level).unionByName(opened), "opened")
    hits = near.unionByName(within(whole, F.col("block") * width - 1)).where("hit <= until")
    kind = series.schema[value].dataType
    best = hits.groupBy("id").agg(F.min(F.struct("hit", "hit_value")).alias("h")).select("id", "h.hit", F.col("h.hit_value").cast(kind).alias("hit_value"))
    return intervals.join(best, "id", "left")
