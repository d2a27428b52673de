"""Checks of tapes and books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.operators.book import DEPTH_COLUMNS
from ticklake.operators.ranges import neighbour


def depth_gate(books: DataFrame, trades_in: DataFrame, trades_out: DataFrame, most_crossed: float = 0.05) -> DataFrame:
    """One row: rows, spreads that are not null, crossed ones, trades before and after, and what holds: as many trades out
    as in, crossed rows ``most_crossed`` of the spreads at most, no level of a negative size."""
    sizes = [c for c in DEPTH_COLUMNS if c.endswith("_size")]
    negative = F.coalesce(F.max(F.greatest(*[F.coalesce((F.col(c) < 0).cast("int"), F.lit(0)) for c in sizes])), F.lit(0))
    crossed = F.count_if(F.coalesce(F.col("spread") < 0, F.lit(False)))
    found = books.agg(F.count("*").alias("n_rows"), F.count("spread").alias("n_spreads"), crossed.alias("n_crossed"), (crossed <= F.count("spread") * most_crossed).alias("crossed_ok"), (negative == 0).alias("sizes_ok"))
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((trades_in, "trades_in"), (trades_out, "trades_out"))]
    return found.crossJoin(counts[0]).crossJoin(counts[1]).withColumn("trades_ok", F.col("trades_in") == F.col("trades_out"))  # one row each


def require_gate(gate: DataFrame) -> None:
    """Raises if any condition of ``depth_gate`` fails."""
    row = gate.first()
    failed = [c for c in ("trades_ok", "crossed_ok", "sizes_ok") if not row[c]]
    if failed:
        raise ValueError(f"{', '.join(failed)} fails: {row.asDict()}")


def null_counts(rows: DataFrame) -> DataFrame:
    """Nulls of every column: column_name, n_null, share."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in rows.columns])
    return counts.select("n", F.explode(pairs).alias("p")).select("p.*", F.round(F.try_divide("p.n_null", F.col("n")), 6).alias("share"))


def sequence_gaps(rows: DataFrame, stream: str, seq: str, width: int = 1_000_000) -> DataFrame:
    """Per stream: gaps in its sequence numbers, numbers missing, and the largest jump; ``width`` numbers are worked at once."""
    before = neighbour(rows.select(stream, seq), [stream], [seq], width, [seq], "__before")
    found = before.withColumn("jump", F.col(seq) - F.col(f"__before.{seq}")).where("jump > 1")
    return found.groupBy(stream).agg(F.count("*").alias("n_gaps"), F.sum(F.col("jump") - 1).alias("missing"), F.max("jump").alias("largest"))


def backward_times(rows: DataFrame, key: str, order: list[str], time: str, width: int) -> DataFrame:
    """Per key: rows whose time is before that of the row ahead of them in arrival order; ``order`` must leave no ties but of equal times."""
    before = neighbour(rows, [key], order, width, [time], "__before")
    return before.withColumn("back", F.col(time) < F.col(f"__before.{time}")).groupBy(key).agg(F.count_if("back").alias("n_backward"), F.count("*").alias("n"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and rows beyond the first of each combination."""
    return rows.groupBy(*columns).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), (F.sum("c") - F.count("*")).alias("n_duplicate"))


def summary(trades: DataFrame, time: str, same: list[str]) -> DataFrame:
    """One row on a trade tape: range, counts, distinct markets, price range, rows with an invalid price or size, rows beyond
    the first that agree in all of ``same``, and the shares of rows with an exchange time (``t_exchange``) and a sequence number."""
    p, s = F.col("price"), F.col("size")
    cover = [F.round(F.avg(F.col(c).isNotNull().cast("int")), 6).alias(n) for c, n in (("t_exchange", "exchange_share"), ("seq", "seq_share"))]
    repeated = duplicates(trades, same).select("n_duplicate")
    return repeated.crossJoin(trades.agg(*cover, F.count("*").alias("n"), F.countDistinct("ticker").alias("n_tickers"), F.min(time).alias("first"), F.max(time).alias("last"), F.min(p).alias("least"), F.max(p).alias("most"), F.count_if(~p.between(1, 99)).alias("bad_price"), F.count_if(s <= 0).alias("bad_size")))  # one row each


def time_gaps(rows: DataFrame, key: str, time: str, over: Column | int, width: int) -> DataFrame:
    """Rows whose time is more than ``over`` after the one before under the key, with the gap."""
    before = neighbour(rows, [key], [time], width, [time], "__before")
    return before.withColumn("gap", F.col(time) - F.col(f"__before.{time}")).drop("__before").where(F.col("gap") > over)


def freshness(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Per input folder: files, those written on the day of ``now``, the time of the latest write and the minutes since."""
    now = F.current_timestamp() if now is None else now
    files = rows.select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    found = files.groupBy(F.regexp_extract("file_path", r"^(.*)/", 1).alias("folder")).agg(F.count("*").alias("n_files"), F.count_if(F.to_date("file_modification_time") == F.to_date(now)).alias("n_today"), F.max("file_modification_time").alias("latest"))
    return found.withColumn("minutes_since", F.floor((F.unix_timestamp(now) - F.unix_timestamp("latest")) / 60))
