"""Typed Parquet tables: writing, idempotent rebuilds, compaction, merging of raw files and the catalogue.

Tables are partitioned by ``date`` and ``v``, sorted by receipt within files, and compressed with zstd.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ticklake.functions.game import LOWER_COEFFICIENTS, QUARTER, QUARTERS, UPPER_COEFFICIENTS
from ticklake.operators.book import DEPTH_COLUMNS, check_metrics, observed
from ticklake.sources import frames
from ticklake.sources.markets import COUNTS, PRICES, TEXTS, TIMES

#: Columns of the typed event tables.
TABLES = {
    "OrderBookUpdate": "t_receipt_ns bigint, t_exchange_ns bigint, market_ticker string, bid_yes int, ask_yes int, bid_size int, ask_size int, sid int, seq int",
    "TradeEvent": "t_receipt_ns bigint, t_exchange_ns bigint, market_ticker string, side string, price int, size int, sid int, seq int",
    "OrderBookDepth": "t_receipt_ns bigint, t_exchange_ns bigint, market_ticker string, seq int, sid int, " + ", ".join(f"{c} int" for c in DEPTH_COLUMNS),
    "BookInvalidated": "t_receipt_ns bigint, market_ticker string",
    "MMQuoteEvent": "t_receipt_ns bigint, market_ticker string, bid_price int, ask_price int, book_bid int, book_ask int, spread int, position int, reason_no_bid string, reason_no_ask string",
    "MMOrderEvent": "t_receipt_ns bigint, market_ticker string, action string, price int, size int, order_id string, reason string, error string",
    "MMFillEvent": "t_receipt_ns bigint, market_ticker string, side string, price int, fill_size int, order_remaining_size int, position_before int, position_after int, maker_fee int, order_id string, book_mid_at_fill double",
    "MMReconcileEvent": "t_receipt_ns bigint, market_ticker string, field string, internal_value string, actual_value string, action_taken string",
    "MMCircuitBreakerEvent": "t_receipt_ns bigint, state string, consecutive_failures int, last_error string",
}
#: The market dimension, without partitions.
MARKETS = ", ".join([f"{c} string" for c in TEXTS] + [f"{c} timestamp" for c in TIMES] + [f"{c} bigint" for c in COUNTS] + [f"{c} int" for c in PRICES])
VERSION = 3
ROW_GROUP = 100_000


def write_events(rows: DataFrame, root: str, date: str, time: str = "t_receipt_ns", version: int = VERSION) -> None:
    """Replaces one date and version of a table; all other partitions stay. A rerun writes the same."""
    placed = rows.withColumns({"date": F.lit(date), "v": F.lit(version)}).sortWithinPartitions(time)
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("parquet.block.row.count.limit", str(ROW_GROUP))
    writer.partitionBy("date", "v").parquet(root)


def read_events(spark: SparkSession, root: str, date: str | list[str] | None = None, version: int = VERSION) -> DataFrame:
    """A table's rows of one version, and of one date or some if given, by partition pruning; ``date`` names each row's."""
    rows = spark.read.parquet(root).where(F.col("v") == version)
    return rows.where(F.col("date").isin(date)) if date else rows


def dates(spark: SparkSession, root: str, least: str | None = None) -> DataFrame:
    """Dates that a table has, in order."""
    found = spark.read.parquet(root).select(F.col("date").cast("string").alias("date")).distinct()
    return (found.where(F.col("date") >= least) if least else found).orderBy("date")


def has_date(spark: SparkSession, root: str, date: str, version: int = VERSION) -> bool:
    try:
        return not read_events(spark, root, date, version).isEmpty()
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def write_gated(books: DataFrame, trades: DataFrame, trades_in: DataFrame, roots: dict[str, str], date: str, staging: str, most_crossed: float | None = 0.05, version: int = VERSION) -> dict:
    """Writes one date of depth rows and trades (``roots`` name both tables' folders) only if they pass the final gate; returns its figures.

    Both go to ``staging`` first, and the jobs that write them count on their way what the gate asks for, so nothing is
    worked out twice: sizes and prices of all levels, crossed rows against spreads, and as many trades as ``trades_in`` has
    frames. If it fails, ValueError is raised and no partition is touched.
    """
    watched, watch = observed(books)
    watched.write.option("compression", "zstd").parquet(f"{staging}/depth")
    counted = Observation(f"trades-{staging.rsplit('/', 1)[-1]}")
    trades.observe(counted, F.count(F.lit(1)).alias("trades_out")).write.option("compression", "zstd").parquet(f"{staging}/trades")
    metrics = watch.get | counted.get | {"trades_in": trades_in.count()}
    if metrics["trades_in"] != metrics["trades_out"]:
        raise ValueError(f"trades: {metrics}")
    check_metrics(metrics, most_crossed)
    spark = books.sparkSession
    for table in ("depth", "trades"):
        rows = spark.read.parquet(f"{staging}/{table}")
        write_events(rows, roots[table], date, "t_receipt_ns" if "t_receipt_ns" in rows.columns else "ord", version)
    return metrics


def compact(spark: SparkSession, root: str, date: str, staging: str, today: str, version: int = VERSION, file_bytes: int = 256 << 20, time: str = "t_receipt_ns") -> DataFrame:
    """Rewrites one partition in as few files as ``file_bytes`` allows; one row: input_files, output_files, total_rows.

    One file or none is left alone. Today and later dates are refused, as they still grow. The rows are first written
    to ``staging``, counted, and only then put in place.
    """
    if date >= today:
        raise ValueError(f"{date} isn't over yet")
    rows = read_events(spark, root, date, version)
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size")).first()
    before = rows.count()
    if files["n"] <= 1:
        return spark.createDataFrame([(files["n"], files["n"], before)], "input_files int, output_files int, total_rows bigint")
    n = max(1, -(-files["size"] // file_bytes))
    rows.drop("date", "v").repartitionByRange(n, time).sortWithinPartitions(time).write.mode("overwrite").option("compression", "zstd").parquet(staging)
    staged = spark.read.parquet(staging)
    if staged.count() != before:
        raise RuntimeError(f"{date}: {before} rows became {staged.count()}")
    write_events(staged, root, date, time, version)
    return spark.createDataFrame([(files["n"], n, before)], "input_files int, output_files int, total_rows bigint")


def archive(lines: DataFrame, root: str) -> None:
    """Appends raw frames (value, channel, date, hour) as gzipped text by channel, date and hour."""
    lines.select("value", "channel", "date", "hour").write.mode("append").option("compression", "gzip").partitionBy("channel", "date", "hour").text(root)


def merge_raw(lines: DataFrame, out: str, file_bytes: int = 1 << 30) -> None:
    """Non-blank lines of many small files in as few gzipped ones as ``file_bytes`` of text each allow, unparsed."""
    rows = lines.where(F.trim("value") != "").select("value")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
    rows.coalesce(max(1, -(-size // file_bytes))).write.mode("overwrite").option("compression", "gzip").text(out)


def write_dated(rows: DataFrame, root: str, dt: str, time: str) -> None:
    """Replaces one day of a flat table under ``dt=``: bronze deltas, snapshots and trades, or a day's book history in ``lob``."""
    placed = rows.withColumn("dt", F.lit(dt)).sortWithinPartitions(time)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("dt").parquet(root)


def read_dated(spark: SparkSession, root: str, dts: list[str]) -> DataFrame:
    """The rows of some days, by partition pruning; ``dt`` names each row's."""
    return spark.read.parquet(root).withColumn("dt", F.col("dt").cast("string")).where(F.col("dt").isin(dts))


FLAT = {"orderbook_snapshot": frames.flat_snapshots, "orderbook_delta": frames.flat_deltas, "trade": frames.flat_trades}


def materialize(parsed: DataFrame, channel: str, out: str) -> None:
    """One channel's frames as one flat table, all dates together, sorted by receipt within files."""
    FLAT[channel](parsed).sortWithinPartitions("t_receipt").write.mode("overwrite").option("compression", "zstd").parquet(out)


def register(spark: SparkSession, name: str, root: str) -> None:
    """An external table over an event table's files, with all partitions found there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({TABLES[name]}, date string, v int) USING parquet PARTITIONED BY (date, v) LOCATION '{root}'")
    spark.sql(f"MSCK REPAIR TABLE `{name}`")


def register_markets(spark: SparkSession, name: str, root: str) -> None:
    """An external table over the market dimension's files."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({MARKETS}) USING parquet LOCATION '{root}'")


def bbo_view(spark: SparkSession, name: str, depth_table: str, least: int = 50) -> None:
    """A view of best bid and offer over a depth table, of rows with ``least`` contracts or more on both sides."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT t_receipt_ns, market_ticker, bid_1, bid_1_size, ask_1, ask_1_size, spread, date, v FROM `{depth_table}` WHERE bid_1_size >= {least} AND ask_1_size >= {least}")


def register_functions(spark: SparkSession) -> None:
    """SQL functions for money, clocks and probabilities."""
    horner = lambda cs: f"{'(' * len(cs)}0D" + "".join(f" * abs(x) + {c!r}D)" for c in cs)
    tail = f"exp(-x * x / 2) * CASE WHEN abs(x) < 7.07D THEN {horner(UPPER_COEFFICIENTS)} / {horner(LOWER_COEFFICIENTS)} ELSE 0D END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_cdf(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x > 0 THEN 1 - {tail} ELSE {tail} END")
    own = r"CASE WHEN clock RLIKE '^PT\\d+M[\\d.]+S$' THEN CAST(regexp_extract(clock, '^PT(\\d+)M', 1) AS DOUBLE) * 60 + CAST(regexp_extract(clock, 'M([\\d.]+)S$', 1) AS DOUBLE) ELSE 0D END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_game_clock(period INT, clock STRING) RETURNS DOUBLE RETURN {own} + CASE WHEN period <= {QUARTERS} THEN ({QUARTERS} - period) * {QUARTER} ELSE 0 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dollars_to_cents(s STRING) RETURNS INT RETURN CAST(rint(CAST(s AS DOUBLE) * 100) AS INT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION maker_fee_cents(c INT) RETURNS INT RETURN greatest(1, CAST(0.0175D * c * (100 - c) / 100 AS INT))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION taker_fee(p DOUBLE) RETURNS DOUBLE RETURN 0.07D * p * (1 - p)")
