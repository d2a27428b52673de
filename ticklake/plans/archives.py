"""Queries through files: what the driver tables hold, written by the sinks and read again by the sources.

Files lie in the shared checkpoint folder, or in a temporary one on a single machine, under a name of their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklake.operators import book
from ticklake.operators.kept import folder
from ticklake.plans.bridge import query
from ticklake.plans.scalars import archive_lines
from ticklake.sources import frames, sinks

DATE = "2026-01-01"
_FLAT = "select ticker, ord, 'delta' as kind, side, price / 100.0 as price, delta * 1.0 as amount from deltas union all select ticker, ord, 'trade', taker, price / 100.0, size * 1.0 from trades"


def _folder(t) -> str:
    return folder(t.spark, "archive")


def _archived(t) -> str:
    """All deltas and trades as gzipped lines by channel, date and hour."""
    root, hour = _folder(t), F.date_format(F.timestamp_seconds(F.get_json_object("value", "$.t_receipt").cast("double")), "HH")
    lines = archive_lines(t).select("value", F.get_json_object("value", "$.channel").alias("channel"), F.lit(DATE).alias("date"), hour.alias("hour"))
    sinks.archive(lines, root)
    return root


def _flat(parsed):
    flat = frames.flat_deltas(parsed).select("ticker", "seq", F.lit("delta").alias("kind"), "side", "price", F.col("delta").alias("amount"))
    both = flat.unionByName(frames.flat_trades(parsed).select("ticker", "seq", F.lit("trade").alias("kind"), F.col("taker").alias("side"), "price", F.col("size").alias("amount")))
    return both.withColumnRenamed("seq", "ord")


@query("s01_k02_archive", _FLAT)
def _(t):
    return _flat(frames.read_date(t.spark, _archived(t), DATE))


@query("s02_k05_merged", _FLAT)
def _(t):
    root = _archived(t)
    for channel in frames.CHANNELS[1:]:
        day = f"{root}/channel={channel}/date={DATE}"
        sinks.merge_raw(frames.read_lines(t.spark, f"{day}/*"), f"{day}/merged")
    return _flat(frames.read_date(t.spark, root, DATE))


def _events(t):
    return t.trades.select((F.col("ord") * 1000).alias("t_receipt_ns"), F.lit(None).cast("bigint").alias("t_exchange_ns"), F.col("ticker").alias("market_ticker"), F.col("taker").alias("side"), "price", F.col("size").cast("int").alias("size"), F.col("sid").cast("int").alias("sid"), F.col("seq").cast("int").alias("seq"))


@query("k01_k04_s05_events", "select ord * 1000 as t_receipt_ns, ticker as market_ticker, taker as side, price, size, case when day % 2 = 0 then '2026-01-01' else '2026-01-02' end as date from trades")
def _(t):
    root, rows = _folder(t), _events(t)
    odd = F.floor(F.col("t_receipt_ns") / 86_400_000_000_000) % 2 == 1
    for date, own in ((DATE, ~odd), ("2026-01-02", odd), (DATE, ~odd)):  # a rebuilt date stands once
        sinks.write_events(rows.where(own), root, date)
    sinks.write_events(rows.limit(1), root, DATE, version=sinks.VERSION - 1)  # another version isn't read
    return sinks.read_events(t.spark, root, [DATE, "2026-01-02"]).select("t_receipt_ns", "market_ticker", "side", "price", "size", F.col("date").cast("string").alias("date"))


@query("k06_d04_compaction", "select ticker as market_ticker, count(*) as n, sum(size) as volume, (select count(*) from trades) as total_rows, true as fewer from trades group by ticker")
def _(t):
    root = _folder(t)
    sinks.write_events(_events(t).repartition(6), root, DATE)
    done = sinks.compact(t.spark, root, DATE, _folder(t), "2026-01-02")
    counted = sinks.read_events(t.spark, root, DATE).groupBy("market_ticker").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    return counted.crossJoin(done.select("total_rows", (F.col("output_files") < F.col("input_files")).alias("fewer")))  # one row


@query("k03_bronze_tables", "select ticker, ord, side, price, delta, case when day % 2 = 0 then '2026-01-01' else '2026-01-02' end as dt from deltas")
def _(t):
    root = _folder(t)
    for k, dt in enumerate((DATE, "2026-01-02")):
        sinks.write_dated(t.deltas.where(F.col("day") % 2 == k).select("ticker", "ord", "side", "price", "delta"), root, dt, "ord")
    return sinks.read_dated(t.spark, root, [DATE, "2026-01-02"])


@query("k07_materialized_trades", "select ticker, ord as seq, taker, price / 100.0 as price, size * 1.0 as size from trades")
def _(t):
    out = _folder(t)
    sinks.materialize(frames.parse(archive_lines(t)), "trade", out)
    return t.spark.read.parquet(out).select("ticker", "seq", "taker", "price", "size")


@query("k10_history_sink", "select ticker, ord as ts, side, price, qty from resting")
def _(t):
    root = _folder(t)
    sinks.write_dated(book.history(t.frames).select("ticker", F.col("ord").alias("ts"), "side", "price", "qty"), root, DATE, "ts")
    return sinks.read_dated(t.spark, root, [DATE]).drop("dt")
