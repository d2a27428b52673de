"""Connected components of a link table: a spanning forest per partition, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm._spark import cut


#: Links in a partition whose forest is found at once.
LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id of the partition's links with the least id that they join it to."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a, b = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    own = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(ids[label[own]], pa.int64())], ["u", "v"])


def _to_least(pairs: DataFrame, others: str) -> DataFrame:
    """Pairs (u, v) become (v, m): m is the least of u and u's partners. ``others`` says which v to keep."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    return joined.where(others).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component_id`` (the least id reachable) of every id in ``links`` (columns ``a`` and ``b``).

    Links may repeat, point either way or to themselves; null ends are left out; no links give no rows. Each step is a
    minimum per id with a join back, so a hub's links stay spread, and is checkpointed; steps grow with the logarithm
    of the longest chain.
    """
    real = cut(links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")))
    parts = -(-real.count() // LINKS)
    forests = real.coalesce(max(1, parts)).mapInArrow(_forest, "u bigint, v bigint")
    edges = cut(forests)
    if parts <= 1:  # one forest is a star per component
        return _labels(edges)
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before or not seen[0]:
            return _labels(edges)
        before = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, "v > u").distinct()  # every partner above u goes to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
