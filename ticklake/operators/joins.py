"""As-of and range joins, and running sums over one global order, each with bounded groups and equality shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], exact: bool = True, forward: bool = False, width: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the right row nearest before (``forward``: after) it under the same keys.

    Both sides are stacked and the last right row is carried along the order, so there is one shuffle and no pair is
    tried in vain. With ``exact`` a right row at the same time counts. Among right rows of one time the greatest by
    ``values`` is taken. Rows without a partner get nulls; right rows without a time are no partners. A column ``asof_on`` has the partner's time.

    With ``width`` time is cut into ranges of that length, each worked for itself on top of the last right row of the
    ranges before it, so that a key with a large part of all rows is spread over tasks.
    """
    tagged_left = left.select(*keys, F.col(left_on).alias("__on"), F.lit(1).alias("__tag"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"), F.lit(None).alias("__seen"))
    carried = F.struct(F.col(right_on).alias("asof_on"), *[F.col(v) for v in values])
    tagged_right = right.select(*keys, F.col(right_on).alias("__on"), F.lit(0 if exact else 2).alias("__tag"), F.lit(None).alias("__row"), carried.alias("__seen")).where(F.col("__on").isNotNull())
    both = tagged_left.unionByName(tagged_right)
    along = lambda c: F.col(c).desc() if forward else F.col(c)
    order = [along("__on"), F.col("__tag"), F.col("__seen")]
    if width:
        both = both.withColumn("__range", F.coalesce(F.floor(F.col("__on") / width).cast("bigint"), F.lit(0)))
        near = F.struct(-F.col("__on") if forward else F.col("__on"), "__seen")
        ends = both.groupBy(*keys, "__range").agg(F.max_by("__seen", F.when(F.col("__seen").isNotNull(), near)).alias("__end"))
        before = Window.partitionBy(*keys).orderBy(along("__range")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("__earlier", F.last("__end", ignorenulls=True).over(before)).drop("__end")
        own = [ends[k].alias(f"__{k}") for k in keys]
        ends = ends.select(*own, F.col("__range").alias("__of"), "__earlier")
        same = F.col("__range") == F.col("__of")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        both = both.join(ends, same, "left")
    w = Window.partitionBy(*keys, *(["__range"] if width else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("__seen", ignorenulls=True).over(w)
    seen = both.withColumn("__last", F.coalesce(last, "__earlier") if width else last).where(F.col("__tag") == 1)
    return seen.select(*[F.col(f"__row.{c}").alias(c) for c in left.columns], "__last.*")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], tolerance: Column, width: int | None = None) -> DataFrame:
    """The nearer of the rows before and after, the one before if level, where it is within ``tolerance``; ``width`` as in ``asof``."""
    mine = left.columns
    back = asof(left, right, keys, left_on, right_on, values, width=width)
    packed = back.select(*mine, F.struct("asof_on", *values).alias("__back"))
    ahead = asof(packed, right, keys, left_on, right_on, values, forward=True, width=width)
    b, a, on = F.col("__back.asof_on"), F.col("asof_on"), F.col(left_on)
    use_back = F.when(b.isNull(), False).when(a.isNull(), True).otherwise(on - b <= a - on)
    best = F.when(use_back, F.col("__back")).otherwise(F.struct("asof_on", *values))
    out = ahead.select(*mine, best.alias("__best"))
    near = F.abs(F.col(left_on) - F.col("__best.asof_on")) <= tolerance
    return out.select(*mine, *[F.when(near, F.col(f"__best.{c}")).alias(c) for c in ("asof_on", *values)])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, before: int, after: int, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and right time within [left - before, left + after].

    Times are cut into buckets as long as the span. A left row stands in its own bucket, and a right row in the two at
    most that hold left rows it can meet, so the join is one of equality and each left row counts once, whatever its
    nulls and repeats. Columns of the two sides must differ but for the keys. ``how``: inner, left, left_semi, left_anti.
    """
    span = max(1, before + after)
    div = lambda c: F.floor(c / span).cast("bigint")
    dealt = left.withColumn("__bucket", div(F.col(left_on)))
    asked = right.withColumn("__bucket", F.explode(F.sequence(div(F.col(right_on) - after), div(F.col(right_on) + before))))
    l, r = dealt.alias("l"), asked.alias("r")
    condition = F.col(f"r.{right_on}").between(F.col(f"l.{left_on}") - before, F.col(f"l.{left_on}") + after)
    for k in [*keys, "__bucket"]:
        condition = condition & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    mine = [F.col(f"l.{c}") for c in left.columns]
    theirs = [F.col(f"r.{c}") for c in right.columns if c not in keys] if how in ("inner", "left") else []
    return l.join(r, condition, how).select(*mine, *theirs)


def running_sum(rows: DataFrame, order: str, value: str, out: str, width: int) -> DataFrame:
    """Sum of ``value`` over all rows up to each in one global order of a whole-number column, without one task for all.

    Rows are dealt into ranges of ``width``; each range sums for itself, on top of the total of the ranges before it,
    which is a window over one row per range.
    """
    dealt = rows.withColumn("__range", F.floor(F.col(order) / width).cast("bigint"))
    totals = dealt.groupBy("__range").agg(F.sum(value).alias("__total"))
    coarse = totals.withColumn("__coarse", F.floor(F.col("__range") / 1024))
    tops = coarse.groupBy("__coarse").agg(F.sum("__total").alias("__top"))
    upper = tops.withColumn("__base", F.coalesce(F.sum("__top").over(Window.orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("__coarse").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = coarse.join(upper, "__coarse").select("__range", (F.col("__base") + F.coalesce(F.sum("__total").over(within), F.lit(0))).alias("__before"))
    own = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(bases, "__range").withColumn(out, F.col("__before") + F.sum(value).over(own)).drop("__range", "__before")
