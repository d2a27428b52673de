"""Jaccard join on word shingles with prefix, length, positional and suffix filters.

A document's shingles are ordered rare first. Two sets of similarity t or more share a shingle among the first
n - ceil(t n) + 1 of either, so only these are joined. A pair is then tested by its sizes, by the places of the common
shingle (shingles before it that no other prefix holds can't be common), by a lower bound on the difference of the
whole sets (counts in ranges of the shingle hash, which stands for the suffix filter), and at last once by its texts.

Links are found without all pairs of a group. Equal sets are one class. Each round links every document to leaders of
its shingles, one from the largest component there and one from another, and joins what is linked. Rounds go on while
pairs between components are more than in proportion to the postings and halve each time. What is left are pairs between
different components, each taken under its first common shingle only, where the smaller set must have it within the
first (1 - t) / (1 + t) of its size: in a group of copies with own changes almost only true links pass that, and these
the rounds have joined. A pair left out is in one component already, so the components are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm._spark import cut, small_side
from ticklake.llm._text import Words, blocks, byte_class, mix
from ticklake.llm.components import components

#: Buckets (as bits of the hash) in which shingle frequencies are counted; a fixed size at any scale. A partition reports
#: what it meets more than once, so that the many shingles of one document cost nothing; sums under ``FEW`` count as 0.
BITS, FEW = 24, 4
#: Bytes of text whose words are worked at once; they take some 60 bytes each meanwhile.
BLOCK_BYTES = 1_000_000
RANGES = 256
#: Pairs a posting up to which all pairs between components are taken, and shared shingles that a posting carries along.
LINEAR, CARRIED = 4, 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``size`` words, with repeats; a row of fewer words has one, of all its words."""
    words = Words(raw, at, byte_class("space"))
    n = words.counts(len(at) - 1)
    end = np.cumsum(n)
    count = len(words.hash)
    place = np.flatnonzero(np.arange(count) + size <= end[words.row]) if count else np.zeros(0, np.int64)
    total = np.zeros(len(place), np.uint64)
    for j in range(size):
        total = total * _STEP + words.hash[place + j]
    row = words.row[place]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        whole = []
        for r in few:
            h = np.full(1, n[r], np.uint64)
            for w in words.hash[end[r] - n[r] : end[r]]:
                h = h * _STEP + w
            whole.append(h[0])
        row, total = np.concatenate([row, few]), np.concatenate([total, np.array(whole, np.uint64)])
        order = np.argsort(row, kind="stable")
        row, total = row[order], total[order]
    return row, mix(total)


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for _, raw, at in blocks(batch, 0, BLOCK_BYTES):
                _, h = shingles(raw, at, size)
                np.add.at(total, (h >> np.uint64(64 - BITS)).astype(np.int64), 1)
        seen = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen].astype(np.int64))], ["bucket", "n"])

    return run


def _profiles(shared, size: int, percent: int):
    names = ["id", "n", "key_1", "key_2", "ranges", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            for part, raw, at in blocks(batch, 1, BLOCK_BYTES):
                row, h = shingles(raw, at, size)
                border = np.searchsorted(row, np.arange(part.num_rows + 1))
                n, key_1, key_2, ranges, prefix, prefix_n = [], [], [], [], [np.zeros(0, np.uint64)], []
                for r in range(part.num_rows):
                    own = np.unique(h[border[r] : border[r + 1]])
                    n.append(len(own))
                    key_1.append(own.sum(dtype=np.uint64))
                    key_2.append(mix(own ^ _STEP).sum(dtype=np.uint64))
                    ranges.append(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=RANGES))
                    keep = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                    rare = np.argsort(frequency[(own >> np.uint64(64 - BITS)).astype(np.int64)], kind="stable")
                    prefix.append(own[rare[:keep]])
                    prefix_n.append(keep)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix_n)]).astype(np.int32)), pa.array(np.concatenate(prefix).view(np.int64)))
                counts = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * RANGES), pa.array(np.minimum(np.concatenate(ranges), 127).astype(np.int8)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(np.array(key_1, np.uint64).view(np.int64)), pa.array(np.array(key_2, np.uint64).view(np.int64)), counts, lists], names)

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in blocks(batch, 2, BLOCK_BYTES):
                ok = np.zeros(part.num_rows, bool)
                row, h = shingles(raw, at, size)
                border = np.searchsorted(row, np.arange(part.num_rows + 1))
                done = 0
                for other, raw_2, at_2 in blocks(part, 3, BLOCK_BYTES):
                    row_2, h_2 = shingles(raw_2, at_2, size)
                    border_2 = np.searchsorted(row_2, np.arange(other.num_rows + 1))
                    for k in range(other.num_rows):
                        x, y = np.unique(h[border[done + k] : border[done + k + 1]]), np.unique(h_2[border_2[k] : border_2[k + 1]])
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        ok[done + k] = 100 * common >= percent * (len(x) + len(y) - common) and common > 0
                    done += other.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def link(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles`` and ``component_id``, the least id reachable by links.

    Words are runs of bytes other than ASCII white space, A-Z as a-z; a document's set holds its distinct runs of
    ``size`` words, or its whole sequence if it has fewer. Two documents link when their sets' intersection is at least
    ``percent`` hundredths of their union. Null, empty and blank texts have no shingles and link with nothing. Rows with
    equal ids count as one document for linking, each with its own ``n_shingles``; a null id has a null component and
    links with nothing. An empty table gives no rows. Other columns are ignored. Ids must be integers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    counted = rows.select("text").mapInArrow(_frequencies(size), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    # a quarter of a doubling is one step; the table has a byte per bucket, and its rows to the driver at most 5
    counted = counted.where(F.col("n") >= FEW).select("bucket", F.least(F.lit(127), F.log2("n") * 4).cast("tinyint").alias("step")).toArrow()
    frequency = np.zeros(1 << BITS, np.int8)
    frequency[counted["bucket"].to_numpy()] = counted["step"].to_numpy()
    shared = spark.sparkContext.broadcast(frequency)
    profiles = cut(rows.mapInArrow(_profiles(shared, size, percent), "id bigint, n bigint, key_1 bigint, key_2 bigint, ranges array<tinyint>, prefix array<bigint>"))
    real = profiles.where("n > 0 and id is not null")
    classes = cut(real.groupBy("key_1", "key_2").agg(F.min_by(F.struct("id", "n", "ranges", "prefix"), "id").alias("first")).select("key_1", "key_2", "first.*"))
    sets = classes.select("id", "n", "ranges")
    found = _links(rows, classes, sets, size, percent)
    grouped = components(found).withColumnRenamed("id", "class_id")
    member = classes.select("key_1", "key_2", F.col("id").alias("class_id")).join(grouped, "class_id", "left")
    out = profiles.select("id", "n", *[F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("key_1", "key_2")]).join(member, ["key_1", "key_2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "class_id", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _links(rows: DataFrame, classes: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links that join all classes that any links join."""
    every = classes.select("id", F.posexplode("prefix").alias("place", "key"))
    often = every.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    # earlier: shingles of this document before this one that others hold too; only these can be common before it
    earlier = F.row_number().over(Window.partitionBy("id").orderBy("place", "key")) - 1
    shared_keys = every.join(often, "key").withColumn("earlier", earlier)
    postings = cut(shared_keys.join(sets.groupBy("id").agg(F.max("n").alias("n")), "id").withColumn("component_id", F.col("id")))
    # the leader of a shingle is the document with fewest rare shingles before it, which is likely to be near the others
    whole = F.struct("place", "id", "n", "earlier", "component_id")
    postings = postings.join(postings.groupBy("key").agg(F.array(F.min(whole)).alias("leaders")), "key")
    links, cross = None, None
    while True:
        leader = postings.withColumn("leader", F.explode("leaders")).where("component_id <> leader.component_id")
        pairs = leader.select("id", F.col("leader.id").alias("other"), "n", F.col("leader.n").alias("m"), "place", F.col("leader.place").alias("at"), F.least("earlier", "leader.earlier").alias("before"))
        new = _verified(pairs.where(_fits(percent)).select("id", "other"), rows, sets, size, percent)
        links = new if links is None else links.unionByName(new)
        labelled = postings.drop("leaders", "component_id").join(components(links), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        labelled = cut(labelled)
        held = labelled.groupBy("key", "component_id").agg(F.count("*").alias("times"), F.count_if(F.expr(_small(percent))).alias("small"), F.min(whole).alias("first"))
        pick = F.min(F.struct(F.xxhash64("component_id", F.lit(str(cross))), F.col("first").alias("one")))
        most = F.struct("times", "first")
        mixed = held.groupBy("key").agg(F.count("*").alias("parts"), F.sum("times").alias("all"), F.sum("small").alias("small"), F.sum(F.col("small") ** 2).alias("within"), F.max(most).alias("most"), pick.alias("pick")).where("parts > 1")
        mixed = cut(mixed.select("key", ((F.col("small") ** 2 - F.col("within")) / 2).alias("pairs"), F.col("all"), F.array("most.first", "pick.one").alias("leaders")))
        left, n = mixed.agg(F.sum("pairs"), F.sum("all")).first()
        if not n:
            return links
        postings = cut(labelled.join(mixed.select("key", "leaders"), "key"))
        if left <= LINEAR * n or cross is not None and left > cross / 2:
            return links.unionByName(_verified(_crossing(postings.drop("leaders"), percent), rows, sets, size, percent))
        cross = left


def _fits(percent: int) -> str:
    """Whether sizes and places of a common shingle allow a link; ``before`` is how many can be common before it at most."""
    return f"least(n, m) * 100 >= {percent} * greatest(n, m) and (before + least(n - place, m - at)) * {100 + percent} >= {percent} * (n + m)"


def _small(percent: int) -> str:
    """Whether a posting can be a link's first common shingle on the side of the smaller set, of which it has at most (1 - t) / (1 + t) before it."""
    return f"place * {100 + percent} <= n * {100 - percent}"


def _crossing(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs between components that may link, each once but for a few, under the first shingle that both hold.

    Each side carries the shared shingles before; a pair that has one of these in common too stands there, not here.
    Sets meet within a class of sizes and the next, each a factor of over 1 / t wide.
    """
    before = Window.partitionBy("id").orderBy("place", "key")
    carried = postings.withColumns({"shared": F.collect_list("key").over(before.rowsBetween(-CARRIED, -1)), "earlier": F.row_number().over(before) - 1})
    carried = cut(carried.withColumn("class", F.floor(F.log("n") / math.log(101 / percent))))
    small = carried.where(_small(percent)).select("key", F.explode(F.array("class", F.col("class") + 1)).alias("class"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("earlier").alias("sooner"), F.col("shared").alias("others"), F.col("component_id").alias("other_component"))
    beyond = f"greatest(earlier - {CARRIED}, 0) + greatest(sooner - {CARRIED}, 0)"
    once = "(m < n or m = n and other < id) and component_id <> other_component and not arrays_overlap(shared, others)"
    return carried.join(small, ["key", "class"]).where(once).where(_fits(percent).replace("before", beyond)).select("id", "other")


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, by the bound of the hash ranges and then by the texts, each pair once."""
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("ranges").alias(f"ranges_{x}"))
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)
    overlap = (F.col("n_a") + F.col("n_b") - apart) / 2  # at most, as the sets differ in ``apart`` shingles at least
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(overlap * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    close = cut(close)
    ids = small_side(cut(close.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    texts = rows.join(ids, "id", "left_semi")
    both = close.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, percent), "a bigint, b bigint"))
