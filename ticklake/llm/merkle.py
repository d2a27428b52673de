"""A Merkle manifest of a table: a tree for each source, a tree over the sources' roots, and a proof for each row.

A node carries the interval of leaf ranks that it covers. Level by level a node finds its parent by containment of
intervals, bucketed by the level's width so that the join is one of equality; its siblings are the children that cover
the rest of the parent's interval. What lies above a node is attached from the top down, at the level of nodes, so a
row meets one parent only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm._spark import cut, fold, small_side

#: Children of a node.
FANOUT = 16
#: A step from a node to the root: the digests left and right of it among its parent's children.
STEP = "struct<left: string, right: string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it goes into a digest: its UTF-8 length, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` from 0 in each group by ``order``, nulls first, without a task that holds a group.

    Rows are dealt into ranges of (group, order), sorted there and written; a row's rank is its place in its file among
    the group's rows plus the group's rows of earlier ranges, of which there is a count for each range and group.
    """
    sorted_ = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    kept = cut(sorted_.withColumn("__place", F.monotonically_increasing_id()))  # partition in the upper bits, row in the lower 33
    part = F.shiftright("__place", 33)
    counts = kept.groupBy(part.alias("__part"), F.col(group).alias("__group")).agg(F.count("*").alias("n"), F.min("__place").alias("__first"))
    before = F.sum("n").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = small_side(cut(counts.select("__part", "__group", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))), 200_000)
    same = (part == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group"))
    return kept.join(starts, same).select(*rows.columns, (F.col("__place") + F.col("__shift")).alias("rank"))


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Inner nodes level by level, from the leaves' parents on, of leaves (tree, rank, digest): tree, lo, hi, digest, children.

    A node covers the ranks from lo up to, not with, hi. ``children`` are its (lo, digest) in order, ``fanout`` at most.
    A tree has no node at a level if one node was left below it.
    """
    most = leaves.agg(F.max("rank")).first()[0]
    nodes, out, width = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest"), [], 1
    while most is not None and most >= width:
        width *= fanout
        run = F.floor(F.col("lo") / width)
        made = nodes.groupBy("tree", run.alias("__run")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("children"))
        made = made.withColumn("digest", digest(F.array_join("children.digest", ""))).drop("__run")
        alone = width // fanout  # a tree of one node so far has its root
        own = cut(made.where((F.col("lo") > 0) | (F.col("hi") > alone)))
        out.append(own)
        nodes = own.drop("children")
    return out


def attach(below: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """Nodes or leaves (tree, lo, hi and others) with the parent that contains them: its ``path`` under their own step.

    ``parents`` have lo, hi, children and path (the steps above them). A node without a parent is a root: its path is empty.
    """
    p = parents.select(F.col("tree").alias("__tree"), F.floor(F.col("lo") / width).alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("children").alias("__children"), F.col("path").alias("__above"))
    inside = (F.floor(F.col("lo") / width) == F.col("__bucket")) & F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi"))
    joined = below.join(p, inside, "left")
    side = lambda keep: F.array_join(F.transform(F.filter("__children", keep), lambda c: c["digest"]), "")
    step = F.struct(side(lambda c: c["lo"] < F.col("lo")).alias("left"), side(lambda c: c["lo"] >= F.col("hi")).alias("right"))
    path = F.when(F.col("__children").isNotNull(), F.concat(F.array(step), "__above")).otherwise(F.array().cast(f"array<{STEP}>"))
    return joined.select(*below.columns, path.alias("path"))


def paths(leaves: DataFrame, inner: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaves (tree, rank, digest and others) with ``path``, their steps to the tree's root, from the leaf on."""
    none = F.array().cast(f"array<{STEP}>")
    above, width = None, fanout ** len(inner)
    for nodes in reversed(inner):
        above = nodes.withColumn("path", none) if above is None else attach(nodes, above, width * fanout)
        width //= fanout
    rows = leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
    return (rows.withColumn("path", none) if above is None else attach(rows, above, fanout)).drop("lo", "hi")


def roots(leaves: DataFrame, inner: list[DataFrame]) -> DataFrame:
    """Each tree's root: tree, digest. A lone leaf is its tree's root; else it is the node of the highest level."""
    last = leaves.groupBy("tree").agg(F.count("*").alias("n"), F.min("digest").alias("digest"), F.lit(0).alias("level")).where("n = 1").drop("n")
    for level, nodes in enumerate(inner, 1):
        last = last.unionByName(nodes.where("lo = 0").select("tree", "digest", F.lit(level).alias("level")))
    return last.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest leads to along its path."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def manifest(rows: DataFrame, source: str, order: list[str], leaf: Column, fanout: int = FANOUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row: source, ``order``, ``carry``, leaf, subroot, root and path (steps from the leaf to the root).

    Leaves of a source ascend by ``order`` (nulls first; ties by leaf digest, so equal rows may stand either way). Sources
    ascend bytewise, null first, and are a tree of their own. An empty table has no rows and no root; a lone leaf is its
    subroot, and a lone subroot the root. No task holds a source: ranks are dealt by ranges, a node gathers ``fanout``.
    """
    named = rows.select(F.col(source).alias("tree"), *[F.col(c).alias(f"k{i}") for i, c in enumerate((*order, *carry))], leaf.alias("digest"))
    leaves = ranked(named, "tree", [*[f"k{i}" for i in range(len(order))], "digest"])
    leaves = cut(leaves)
    inner = levels(leaves, fanout)
    subroots = cut(roots(leaves, inner))
    tops = ranked(subroots.select(F.lit(0).alias("__all"), F.col("tree").alias("name"), F.col("digest")), "__all", ["name"]).withColumnRenamed("__all", "tree")
    tops = cut(tops)
    upper = levels(tops, fanout)
    root = roots(tops, upper).select(F.col("digest").alias("root"))
    above = paths(tops, upper, fanout).select(F.col("name").alias("__source"), F.col("digest").alias("subroot"), F.col("path").alias("__top")).crossJoin(F.broadcast(root))  # one row
    below = paths(leaves, inner, fanout)
    sources = small_side(cut(above), 2_000)
    out = below.join(sources, F.col("tree").eqNullSafe(F.col("__source")))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate((*order, *carry))]
    return out.select(F.col("tree").alias(source), *names, F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "__top").alias("path"))


def proof(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right; of nothing if there are none."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def verify(docs: DataFrame, changed: Column, doc_id: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """The documents' manifest, and whether each still leads to the root where rows of ``changed`` have their text in lower case (A-Z).

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Nulls of any field are ``-`` in its leaf; a
    null text stays null. Rows that repeat an id are leaves of their own; extra columns are ignored; no rows give none.
    """
    fields = [field(F.col(c)) for c in (doc_id, "source", "lang", "n_chars")]
    lowered = F.when(changed, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    own = docs.select(F.col(doc_id), F.col("source"), digest(*fields, field(F.col("text"))).alias("leaf"), F.when(changed, digest(*fields, field(lowered))).alias("__now"))
    found = manifest(own, "source", [doc_id], F.col("leaf"), fanout, carry=("__now",))
    again = folded(F.coalesce("__now", "leaf"), F.col("path"))
    out = found.select(doc_id, "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: str = "doc_id") -> Column:
    """Documents whose id's crc32 is a multiple of 5; none without an id."""
    return F.col(doc_id).isNotNull() & (fold(doc_id, 5) == 0)
