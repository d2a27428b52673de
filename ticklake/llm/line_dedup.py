"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared by their words. Of equal lines the earliest stays. Near lines may differ in a share of their words
only, one in ``min_words``, and in one at most: a line of so many words is dropped too if an earlier one of that size is
within one edit of it, a word replaced, inserted or deleted. In fewer words one edit makes another line, and unrelated
short lines lie within it by chance. Every line that may have near ones emits the variants that lack one word, as hashed
keys with their length:

* two lines of equal length with equal variants at the same place differ by one replaced word;
* a variant that equals a shorter line means one inserted or deleted word.

So all lines under a key are true neighbours, and each needs to meet only the earliest of them, never every other.
A word's share in a variant's hash depends on its place in the variant, so all variants of a line come from running
sums over its words. An edit leaves one half of the shorter line as it is. So lines first look for others with an equal
half, and emit only variants that lack a word outside it; lines without such a half emit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm._spark import BROADCAST_IDS, cut, free_names, small_side

#: White space that is one space: all of ASCII's but the newline, which ends a line.
SPACE = r"[\x20\x09\x0B-\x0D]+"


def _norm(text: Column) -> Column:
    """Lower case with runs of white space as one space; lines are still to be trimmed."""
    low = F.lower(text)
    return F.when(low.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(low, SPACE, " ")).otherwise(low)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _n_words(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09\x0B-\x0D]")


def _part(value: Column, place: Column, salt: int) -> Column:
    """A word's share in the hash of a sequence that has it at ``place``; small enough that long sums fit."""
    return F.shiftright(F.xxhash64(value, place, F.lit(salt)), 24)


def earliest_lines(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """Distinct non-blank lines: the earliest place, and for long lines the hashes of their halves.

    A half has as many words as half of the line, or of the line less one word.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.posexplode(_lines(_norm(F.col(text)))).alias("line", "raw")).select("doc", "line", F.trim("raw").alias("norm")).where("norm <> ''")
    rows = rows.withColumn("n", _n_words(F.col("norm")))
    halves = {}
    for k, less in enumerate(("n div 2", "(n - 1) div 2")):
        for side, sign in (("first", ""), ("last", "-")):
            halves[f"{side}_{k}"] = F.expr(f"case when n >= {min_words} and (n % 2 = 0 or {k} = 0) then xxhash64(substring_index(norm, ' ', {sign}cast({less} as int)), '{side}', {less}) end")
    keyed = rows.select(F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.struct("doc", "line").alias("at"), *[c.alias(k) for k, c in halves.items()])
    return keyed.groupBy("h1", "h2").agg(F.min("at").alias("at"), *[F.min(k).alias(k) for k in halves]).select("at.*", *halves)


def _near(docs: DataFrame, distinct: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Places of lines with an earlier neighbour."""
    names = ["first_0", "first_1", "last_0", "last_1"]
    each_half = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("kind"), F.col(name).alias("half")) for k, name in enumerate(names)])
    halves = distinct.where("first_0 is not null").select("doc", "line", F.explode(each_half).alias("h")).select("doc", "line", "h.*").where("half is not null")
    often = small_side(cut(halves.groupBy("half").agg(F.count("*").alias("times")).where("times > 1").select("half")))
    longest = [F.max(F.when(F.col("kind").between(lo, lo + 1), F.col("kind") - lo)).cast("int").alias(side) for side, lo in (("first", 0), ("last", 2))]
    shared = halves.join(often, "half", "left_semi").groupBy("doc", "line").agg(*longest)
    asked = cut(shared.groupBy("doc").agg(F.collect_list(F.struct("line", "first", "last")).alias("asked")))
    if asked.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0] <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    rows = docs.select(F.col(doc_id).alias("doc"), _lines(_norm(F.col(text))).alias("lines")).join(asked, "doc").select("doc", "lines", F.explode("asked").alias("a"))
    rows = rows.where("a.line < size(lines)").select(F.struct("doc", "a.line").alias("at"), "a.first", "a.last", F.split(F.trim(F.element_at("lines", F.col("a.line") + 1)), " ").alias("words"))
    lines = cut(rows)
    emitted = _variants(lines)
    roles = {"replaced": 0, "longer": 1, "shorter": 2}
    least = emitted.groupBy("key").agg(F.count("*").alias("times"), *[F.min(F.when(F.col("role") == k, F.col("at"))).alias(r) for r, k in roles.items()]).where("times > 1").drop("times")
    partner = F.when(F.col("role") == 0, F.col("replaced")).when(F.col("role") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = cut(emitted.join(small_side(cut(least)), "key").select("at", partner.alias("first")).where("first < at").distinct())
    words = lines.select("at", "words")
    sides = pairs.join(words, "at").join(words.select(F.col("at").alias("first"), F.col("words").alias("others")), "first")
    return sides.where(within_one_edit(F.col("words"), F.col("others"))).select("at.*").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """Keys of all lines: 0 for a variant at its place, 1 for a variant as a shorter line, 2 for the line itself."""
    each = lines.repartition("at").select("at", "first", "last", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    for salt in (1, 2):
        each = each.withColumns({f"kept_{salt}": _part(F.col("word"), F.col("i"), salt), f"moved_{salt}": _part(F.col("word"), F.col("i") - 1, salt)})
    whole = Window.partitionBy("at")
    before = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {f"{x}_{salt}_{name}": F.sum(f"{x}_{salt}").over(w) for x in ("kept", "moved") for salt in (1, 2) for name, w in (("all", whole), ("upto", before))}
    each = each.withColumns(run)
    v = [F.col(f"kept_{s}_upto") - F.col(f"kept_{s}") + F.col(f"moved_{s}_all") - F.col(f"moved_{s}_upto") for s in (1, 2)]
    row = lambda role, *of: F.struct(F.lit(role).cast("tinyint").alias("role"), F.xxhash64(*of).alias("key"))
    lacks = F.expr("coalesce(i >= (n - first) div 2, false) or coalesce(i < n - (n - last) div 2, false)")
    keys = F.array_compact(
        F.array(
            F.when(lacks, row(0, *v, F.col("n"), F.col("i") + 1)),
            F.when(lacks, row(1, *v, F.col("n") - 1, F.lit(0))),
            F.when(F.col("i") == 0, row(2, F.col("kept_1_all"), F.col("kept_2_all"), F.col("n"), F.lit(0))),
        )
    )
    return each.where(lacks | (F.col("i") == 0)).select("at", F.explode(keys).alias("k")).select("at", "k.*")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one word replaced, inserted or deleted makes ``a`` into ``b``: their common ends leave one word at most."""
    longer = F.greatest(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differ == 0, F.size(x)).otherwise(differ - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with each text's lines but for those that repeat an earlier line or are within one edit of it.

    Lines end at newlines and are compared in lower case with white space as one space; earlier means a lower id, then a
    lower place in the text. Blank lines stay and count for nothing. A null text stays null, an empty one empty; a text
    whose lines all repeat becomes empty (or its blank lines). Rows with equal ids count as one document, of which each
    row keeps the places kept for that id; rows with a null id stay as they are and are compared with nothing. An empty
    table gives no rows. Other columns stay. ``counts`` names two columns to add: non-blank lines before and after.
    """
    if min_words < 3:
        raise ValueError("min_words must be 3 at least")
    own_doc, own_kept, own_lines = free_names(docs.columns, "__doc", "__kept", "__lines")
    named = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text)
    distinct = cut(earliest_lines(named, doc_id, text, min_words))
    near = _near(named, distinct, doc_id, text)
    kept = distinct.join(near, ["doc", "line"], "left_anti").groupBy(F.col("doc").alias(own_doc)).agg(F.collect_list("line").alias(own_kept))
    lines = F.col(own_lines)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    blank = F.filter(places, lambda i: _blank(F.element_at(lines, i + 1)))
    stay = F.array_sort(F.array_union(F.coalesce(own_kept, F.array().cast("array<int>")), blank))
    stay = F.when(F.col(doc_id).isNull(), places).otherwise(F.filter(stay, lambda i: i < F.size(lines)))
    new = F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")
    joined = docs.join(kept, docs[doc_id] == F.col(own_doc), "left").withColumn(own_lines, _lines(F.col(text)))
    out = [F.when(F.col(text).isNotNull(), new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.when(F.col(text).isNotNull(), F.size(F.filter(lines, lambda x: ~_blank(x)))).otherwise(0)
        k = F.when(F.col(doc_id).isNull(), n).otherwise(F.coalesce(F.size(own_kept), F.lit(0)))
        out += [n.cast("bigint").alias(counts[0]), k.cast("bigint").alias(counts[1])]
    return joined.select(*out)
