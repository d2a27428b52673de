"""Embedding near-duplicates by product quantisation over inverted lists.

Coarse centres split the unit vectors, and each coarse cell has centres of its own, in proportion to its vectors; these
are the inverted lists, so lists grow with the table and keep their size. A vector stands in the nearest lists of its
nearest cells, ``probes`` in all. In each list its residual is coded by the nearest codeword of each subspace, and the
length of what the code misses is kept. Within a list every vector asks all others: table lookups give the distance from
the exact vector to each code, and as the missed length bounds its error, a code farther than the limit plus that length
is no partner. The rest are compared exactly.

Lists are worked in blocks of bounded size, each pair of a list's blocks a group of its own. A group returns per vector
a count and one link of a spanning forest, never its pairs. A pair that shares several lists counts in the lowest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklake.llm._spark import cut, small_side
from ticklake.llm.components import components

SUBSPACES, CODEWORDS = 8, 256
#: Vectors that the coarse centres and codewords are fitted on at most, vectors per list aimed at, vectors in a block,
#: vectors that one task lists, vectors that a list's centre is fitted on, and lists in a cell (a fuller cell has longer
#: lists, worked in more pairs of blocks).
SAMPLE, PER_LIST, BLOCK, DEALT, PER_CENTRE, CELL = 40_000, 400, 2048, 50_000, 16, 4096


class Index:
    """Coarse centres (unit vectors) and the codewords of each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, cells: int, lists: int):
        rng = np.random.default_rng(3)
        self.centres = _means(sample, cells, rng, 8)
        near = _nearest(sample, self.centres, 1)[:, 0]
        residual = np.empty_like(sample)
        for k in np.unique(near):
            own = sample[near == k]
            fine = _means(own, max(1, min(lists // cells, len(own) // 4)), rng, 4)
            residual[near == k] = own - fine[_nearest(own, fine, 1)[:, 0]]
        width = residual.shape[1] // SUBSPACES
        self.words = np.stack([_means(residual[:, m * width : (m + 1) * width], CODEWORDS, rng, 6) for m in range(SUBSPACES)])

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes, and the lengths that they miss."""
        width = self.words.shape[2]
        parts = [residual[:, m * width : (m + 1) * width] for m in range(SUBSPACES)]
        codes = np.stack([_nearest(x, w, 1)[:, 0] for x, w in zip(parts, self.words, strict=True)], 1)
        missed = sum(((x - w[c]) ** 2).sum(1) for x, w, c in zip(parts, self.words, codes.T, strict=True))
        return codes.astype(np.uint8), np.sqrt(missed)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of exact residuals (rows) to codes (columns), from one table per residual."""
        width, total = self.words.shape[2], np.zeros((len(residual), len(codes)), np.float32)
        for m in range(SUBSPACES):
            own = residual[:, m * width : (m + 1) * width]
            tables = (own**2).sum(1)[:, None] - 2 * own @ self.words[m].T + (self.words[m] ** 2).sum(1)
            total += tables.astype(np.float32)[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 8192):
        gap = (centres**2).sum(1) - 2 * x[lo : lo + 8192] @ centres.T
        best = np.argpartition(gap, k - 1, 1)[:, :k] if k < gap.shape[1] else np.tile(np.arange(k), (len(gap), 1))
        out[lo : lo + 8192] = np.take_along_axis(best, np.argsort(np.take_along_axis(gap, best, 1), 1, kind="stable"), 1)
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """k-means; a centre that loses its vectors stays where it is."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=c, minlength=k) for c in x.T], 1)
        centres = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], centres)
    return centres


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one size, scaled to length 1 in double precision, with zeros up to ``width``. The greatest component is
    divided out first, so that no square overflows or vanishes."""
    x = np.zeros((len(column), width))
    if len(column):
        own = column.flatten().to_numpy().astype(float).reshape(len(column), -1)
        x[:, : own.shape[1]] = own / np.abs(own).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def _cells(shared, width: int, probes: int, drawn: dict[int, float] | None = None):
    """The nearest cells of each vector, by rank; with ``drawn`` only its nearest, of the vectors whose ``draw`` is below the cell's rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.centres
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                near = _nearest(_unit(part.column(1), width), centres, 1 if drawn is not None else probes)
                if drawn is not None:
                    rate = np.array([drawn.get(k, 1.0) for k in near[:, 0].tolist()])
                    keep = pa.array(part.column(2).to_numpy() < rate)
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, 0].astype(np.int32)).filter(keep), part.column(1).filter(keep)], ["cell", "vector"])
                    continue
                for rank in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, rank].astype(np.int32)), pa.array(np.full(len(near), rank, np.int32)), part.column(0), part.column(1)], ["cell", "rank", "id", "vector"])

    return run


def _centred(width: int, sizes: dict[int, int]):
    """The list centres of a cell, fitted on its drawn vectors."""

    def run(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        x = _unit(table["vector"].combine_chunks(), width)
        k = min(sizes[cell], len(x))
        centres = _means(x, k, np.random.default_rng(5 + cell), 6)
        return pa.table({"cell": pa.array([cell] * k, pa.int32()), "list": pa.array(np.arange(k) + cell * CELL), "centre": pa.array(list(centres))})

    return run


def _listed(shared, width: int, probes: int):
    """Of a cell's vectors: the nearest lists, with codes and missed lengths."""

    def run(vectors: pa.Table, centres: pa.Table) -> pa.Table:
        index: Index = shared.value
        out = {"id": [], "list": [], "code": [], "missed": []}
        if vectors.num_rows and centres.num_rows:
            number, fine = centres["list"].to_numpy(), np.stack(centres["centre"].to_numpy())
            ids, column = vectors["id"].combine_chunks(), vectors["vector"].combine_chunks()
            for lo in range(0, len(ids), 4096):
                x = _unit(column.slice(lo, 4096), width)
                near = _nearest(x, fine, min(probes, len(fine)))
                for rank in range(near.shape[1]):
                    codes, missed = index.code(x - fine[near[:, rank]])
                    out["id"].append(ids.slice(lo, 4096).to_numpy())
                    out["list"].append(number[near[:, rank]])
                    out["code"] += [c.tobytes() for c in codes]
                    out["missed"].append(missed)
        whole = lambda c, kind: pa.array(np.concatenate(out[c]) if out[c] else np.zeros(0), kind)
        return pa.table({"id": whole("id", pa.int64()), "list": whole("list", pa.int64()), "code": pa.array(out["code"], pa.binary()), "missed": whole("missed", pa.float64())})

    return run


def _linked(shared, least: float, width: int):
    """Links within one pair of a list's blocks; the row without an id is the list's centre."""
    reach = np.sqrt(2 - 2 * least) + 1e-5

    def run(table: pa.Table) -> pa.Table:
        index: Index = shared.value
        here, first, second = table["list"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
        centre = np.array(table.filter(pc.is_null(table["id"]))["vector"][0].as_py())
        table = table.filter(pc.is_valid(table["id"])).combine_chunks()
        get = lambda c: table[c].combine_chunks()
        ids, times, own = (get(c).to_numpy() for c in ("id", "times", "block"))
        x = _unit(get("vector"), width)
        sizes = get("lists").value_lengths().to_numpy() if len(ids) else np.zeros(0, np.int64)
        held = np.full((len(ids), int(sizes.max(initial=1))), -1, np.int64)  # a vector's lists, and below them places of none
        held[np.arange(held.shape[1]) < sizes[:, None]] = get("lists").flatten().to_numpy() if len(ids) else np.zeros(0, np.int64)
        codes, missed = np.frombuffer(b"".join(get("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES), get("missed").to_numpy()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        residual = x - centre
        counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(left) and len(right):
            for lo in range(0, len(left), 256):
                ask = left[lo : lo + 256]
                near = index.distances(residual[ask], codes[right]) <= reach + missed[right]
                some = np.flatnonzero(near.any(0))
                if not len(some):
                    continue
                cosine = x[ask] @ x[right[some]].T
                a, b = np.nonzero(near[:, some] & (cosine >= least))
                a, b = ask[a], right[some[b]]
                a, b = a[a != b], b[a != b]
                both = (held[a][:, :, None] == held[b][:, None, :]) & (held[a][:, :, None] >= 0)
                common = np.where(both, held[a][:, :, None], np.iinfo(np.int64).max).min((1, 2))
                once = common == here
                np.add.at(counts, a[once], times[b[once]])
                if first != second:
                    np.add.at(counts, b[once], times[a[once]])
                while True:  # the least place reachable, by these links and those before
                    before = label.copy()
                    np.minimum.at(label, a, label[b])
                    np.minimum.at(label, b, label[a])
                    label = label[label]
                    if (before == label).all():
                        break
                label = _settled(label)
        some = np.flatnonzero((counts > 0) | (label != np.arange(len(ids))))
        return pa.table({"id": pa.array(ids[some], pa.int64()), "n_links": counts[some], "other": pa.array(ids[label[some]], pa.int64())})

    return run


def _settled(label: np.ndarray) -> np.ndarray:
    while (label[label] != label).any():
        label = label[label]
    return label


def _found(classes: DataFrame, n: int, size: int, least: float, probes: int) -> DataFrame:
    """Links found among classes (class, times, v, draw) whose vectors have one size: id, n_links and a forest's link."""
    spark = classes.sparkSession
    width = -(-size // SUBSPACES) * SUBSPACES
    lists = max(1, n // PER_LIST)
    cells = math.isqrt(lists - 1) + 1
    # more probes take more cells first, as a neighbour beyond a cell's border is missed by all its lists
    of_cells = min(cells, math.isqrt(probes - 1) + 1)
    sample = classes.where(F.col("draw") < min(1.0, SAMPLE / n)).orderBy("class").select("v").toArrow()
    if not sample.num_rows:
        sample = classes.orderBy("draw", "class").limit(1).select("v").toArrow()
    shared = spark.sparkContext.broadcast(Index(_unit(sample["v"].combine_chunks(), width), cells, lists))
    near = classes.select("class", "v").mapInArrow(_cells(shared, width, of_cells), "cell int, rank int, id bigint, vector array<double>")
    counts = near.groupBy("cell").agg(F.count("*").alias("all"), F.count_if(F.col("rank") == 0).alias("own")).collect()  # a row per cell
    wanted = {r["cell"]: min(CELL, -(-r["own"] // PER_LIST)) for r in counts if r["own"]}
    drawn = {k: min(1.0, max(PER_CENTRE * w, 256) / next(r["own"] for r in counts if r["cell"] == k)) for k, w in wanted.items()}
    picked = classes.select("class", "v", "draw").mapInArrow(_cells(shared, width, 1, drawn), "cell int, vector array<double>")
    centres = cut(picked.groupBy("cell").applyInArrow(_centred(width, wanted), "cell int, list bigint, centre array<double>"))
    parts = spark.createDataFrame([(r["cell"], -(-r["all"] // DEALT)) for r in counts], "cell int, parts bigint")
    dealt = near.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    copies = parts.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    spread = centres.join(copies, "cell")
    schema = "id bigint, list bigint, code binary, missed double"
    listed = dealt.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(_listed(shared, width, -(-probes // of_cells)), schema)
    each = cut(listed.groupBy("id").agg(F.collect_list(F.struct("list", "code", "missed")).alias("in_lists")))
    blocks = small_side(cut(each.select(F.explode("in_lists.list").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))))
    rows = classes.select(F.col("class").alias("id"), "times", F.col("v").alias("vector")).join(each, "id").select("id", "times", "vector", F.sort_array("in_lists.list").alias("lists"), F.explode("in_lists").alias("in"))
    rows = rows.select("id", "times", "vector", "lists", "in.*").join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    rows = rows.withColumn("pair", F.explode(every)).drop("blocks")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    marks = centres.join(blocks, "list").select("list", F.col("centre").alias("vector"), F.explode(pairs).alias("pair"))
    groups = rows.unionByName(marks, allowMissingColumns=True).select("list", "pair.*", "block", "id", "times", "vector", "lists", "code", "missed")
    return cut(groups.groupBy("list", "i", "j").applyInArrow(_linked(shared, least, width), "id bigint, n_links bigint, other bigint"))


def link(vectors: DataFrame, least: float = 0.9, probes: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: its id, ``n_links`` (other vectors with cosine ``least`` or more that were found),
    ``component_id`` (the least id reachable) and ``kept`` (id and component are the same).

    Cosines are taken in double precision; none below ``least`` links. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing, nor do vectors of different sizes, each of which has an index of its
    own. Equal vectors are one class with its number of copies; all link. Rows with equal ids count each as a vector; a
    null id gets a null component and links with nothing. An empty table gives no rows. Other columns are ignored. The
    coarse centres and the codewords are fitted in the driver on at most ``SAMPLE`` distinct vectors of a size, each
    list's centre in Spark on ``PER_CENTRE`` vectors; all vectors are indexed. More ``probes`` find more.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & F.coalesce(finite & (F.size("v") > 0) & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = rows.select("id", F.when(good, F.xxhash64("v")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "v")).alias("h2"), F.when(good, F.col("v")).alias("v"))
    classes = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("class"), F.count("*").alias("times"), F.first("v").alias("v"))
    classes = cut(classes.withColumns({"size": F.size("v"), "draw": F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 40)) / float(1 << 40)}))
    sizes = classes.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").orderBy("size").collect()
    none = keyed.sparkSession.createDataFrame([], "id bigint, n_links bigint, other bigint")
    found = reduce(DataFrame.unionByName, [_found(classes.where(F.col("size") == r["size"]), r["n"], r["size"], least, probes) for r in sizes], none)
    counts = found.groupBy(F.col("id").alias("class")).agg(F.sum("n_links").alias("links"))
    grouped = components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "class")
    member = classes.select("h1", "h2", "class", "times").join(counts, "class", "left").join(grouped, "class", "left")
    out = keyed.select("id", "h1", "h2").join(member, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "class", "id")
    return out.select(F.col("id").alias(vec_id), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
