"""The Merkle manifest against a tree built by hand, and its edge cases."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from ticklake.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, path string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(leaves, fanout):
    """The root, and each leaf's (left, right) digests from the bottom up."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, place in enumerate(at):
            lo = place // fanout * fanout
            steps[k].append(("".join(level[lo:place]), "".join(level[place + 1 : lo + fanout])))
        level = [h(*level[lo : lo + fanout]) for lo in range(0, len(level), fanout)]
        at = [place // fanout for place in at]
    return level[0], steps


def by_hand(rows, fanout):
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = own, *climb([leaf(r, r[1]) for r in own], fanout)
    root, tops = climb([trees[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, tops, strict=True):
        own, subroot, steps = trees[s]
        for r, step in zip(own, steps, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed and r[1] is not None else r[1]
            now = leaf(r, text)
            for left, right in [*step, *top]:
                now = h(left, now, right)
            out.append((r[0], leaf(r, r[1]), subroot, root, h(*[left + right for left, right in [*step, *top]]), now, now == root))
    return out


def found(df, fanout):
    return [tuple(r) for r in merkle.verify(df, merkle.tampered(), fanout=fanout).collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_manifest_equals_a_tree_by_hand(spark):
    rng = random.Random(5)
    sources = [None, "", "a", "B", "ä", "web", "web", "web", "web"]
    rows = [(k, rng.choice(["Ein Text ÄÖ", "lower", "", None, "X" * 3_000_000]) if k % 50 == 7 else f"Text {k} Ä", rng.choice(["de", None]), rng.choice(sources), rng.choice([None, k]), 1, "p") for k in range(300)]
    rows += [(None, "no id", None, "web", 3, 1, "p"), (5, "again", None, "web", 3, 1, "p"), rows[9], rows[9]]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    for fanout in (2, 3, 16):
        assert order(found(df, fanout)) == order(by_hand(rows, fanout))


def test_sizes_about_the_fanout(spark):
    for n in (1, 2, 15, 16, 17, 33, 257):
        rows = [(k, f"T{k}", "x", "one", k, 0, None) for k in range(n)]
        assert order(found(spark.createDataFrame(rows, DOCS), 16)) == order(by_hand(rows, 16)), n


def test_many_sources_of_one_row(spark):
    rows = [(k, f"T{k}", "x", f"s{k}", k, 0, None) for k in range(40)]
    assert order(found(spark.createDataFrame(rows, DOCS), 4)) == order(by_hand(rows, 4))


def test_no_rows(spark):
    assert found(spark.createDataFrame([], DOCS), 16) == []


def test_ranks_in_a_hot_group(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 5003).alias("x"), F.lit(1).alias("extra")).repartition(5)
    got = [(r["x"], r["rank"]) for r in merkle.ranked(rows, "g", ["x"]).collect()]
    assert sorted(got) == [(x, k) for k, x in enumerate(sorted(x for x, _ in got))]
