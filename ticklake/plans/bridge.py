"""Market tables projected from the driver's tables, in DataFrames and in the SQL that the oracles start from.

``events``: signups are snapshots, views and clicks YES and NO deltas, purchases and errors trades.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables by name, and market tables made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def ev(self) -> DataFrame:
        t_us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
        k = F.get_json_object("props", "$.k").cast("int")
        rows = self("events").select("event_id", "user_id", "event_type", "value", k.alias("k"), t_us.alias("ord"))
        day = F.floor(F.col("ord") / 86_400_000_000).cast("bigint")
        return rows.select(
            "*",
            F.concat(F.lit("M"), F.col("user_id") % 20).alias("ticker"),
            day.alias("day"),
            F.concat(F.lit("c"), F.floor(day / 5)).alias("conn"),
            (1 + F.floor(day / 5)).alias("sid"),
            F.col("event_id").alias("seq"),
            F.floor("value").cast("int").alias("v"),
        )

    @property
    def frames(self) -> DataFrame:
        e = self.ev
        kind = F.when(F.col("event_type") == "signup", "snapshot").when(F.col("event_type").isin("view", "click"), "delta").otherwise("trade")
        yes = F.col("event_type") == "view"
        i = F.sequence(F.lit(1), F.lit(5))
        level = lambda side, shift: F.transform(i, lambda x: F.struct(F.lit(side).alias("side"), (4 + 9 * (x - 1) + (F.col("k") + shift) % 9).alias("price"), (10 * x + (F.col("k") + shift) % 10).cast("bigint").alias("qty")))
        return e.select(
            "ticker", "ord", kind.alias("kind"), "conn", "sid", "seq", "day",
            F.when(kind == "delta", F.when(yes, "yes").otherwise("no")).alias("side"),
            F.when(kind == "delta", F.when(yes, 30 + F.col("k") % 26).otherwise(30 + (F.col("k") * 7) % 30)).alias("price"),
            F.when(kind == "delta", F.col("v") % 41 - 28).cast("bigint").alias("delta"),
            F.when(kind == "snapshot", F.concat(level("yes", 0), level("no", 13))).alias("levels"),
        )

    @property
    def trades(self) -> DataFrame:
        no = F.col("event_type") == "purchase"
        return self.ev.where("event_type in ('purchase', 'error')").select(
            "ticker", "ord", "day", "user_id", "conn", "sid", "seq",
            F.when(no, 30 + F.col("k") % 26).otherwise(70 - (F.col("k") * 7) % 30).alias("price"),
            (1 + F.col("v") % 7).cast("bigint").alias("size"),
            F.when(no, "no").otherwise("yes").alias("taker"),
        )

    @property
    def deltas(self) -> DataFrame:
        return self.frames.where("kind = 'delta'").drop("kind", "levels")

    @property
    def tape(self) -> DataFrame:
        """A large trade tape from ``lineitem``."""
        t = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
        return self("lineitem").select(
            F.col("l_partkey").alias("ticker"), t.alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
            F.col("l_returnflag").alias("flag"), (1 + F.floor("l_extendedprice").cast("bigint") % 99).alias("price"), F.col("l_quantity").cast("bigint").alias("size"), "l_suppkey",
        )

    @property
    def fills(self) -> DataFrame:
        """Fills from ``orders``: a market per customer, bought on even keys."""
        o = F.col("o_orderkey")
        return self("orders").select(
            F.col("o_custkey").alias("ticker"), o.alias("ord"),
            F.when(o % 2 == 0, "buy").otherwise("sell").alias("side"), (20 + o % 61).cast("int").alias("price"), (1 + o % 5).alias("n"),
            F.expr("datediff(cast(o_orderdate as date), date'1970-01-01')").alias("day"),
        )

    @property
    def markets(self) -> DataFrame:
        """Results of the markets of ``fills``."""
        c = F.col("c_custkey")
        return self("customer").select(c.alias("ticker"), F.when(c % 3 == 0, "yes").when(c % 3 == 1, "no").alias("result"), "c_mktsegment")


#: The same tables for DuckDB.
BASE = """
ev as (
  select event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k, epoch_us(ts) as ord,
    'M' || (user_id % 20) as ticker, epoch_us(ts) // 86400000000 as day, 'c' || (epoch_us(ts) // 86400000000 // 5) as conn,
    1 + epoch_us(ts) // 86400000000 // 5 as sid, event_id as seq, cast(floor(value) as int) as v from events
), trades as (
  select ticker, ord, day, user_id, conn, sid, seq, case when event_type = 'purchase' then 30 + k % 26 else 70 - (k * 7) % 30 end as price,
    1 + v % 7 as size, case when event_type = 'purchase' then 'no' else 'yes' end as taker from ev where event_type in ('purchase', 'error')
), deltas as (
  select ticker, ord, day, conn, sid, seq, case when event_type = 'view' then 'yes' else 'no' end as side,
    case when event_type = 'view' then 30 + k % 26 else 30 + (k * 7) % 30 end as price, v % 41 - 28 as delta from ev where event_type in ('view', 'click')
), snapshots as (
  select ticker, ord, conn, sid, k from ev where event_type = 'signup'
), seeds as (
  select ticker, ord as epoch, side, 4 + 9 * (i - 1) + (k + shift) % 9 as price, 10 * i + (k + shift) % 10 as qty
  from snapshots, (values (1), (2), (3), (4), (5)) x(i), (values ('yes', 0), ('no', 13)) y(side, shift)
), epochs as (
  select d.*, s.ord as epoch, s.sid as epoch_sid from deltas d asof left join snapshots s on d.ticker = s.ticker and d.conn = s.conn and d.ord >= s.ord
), live as (
  select * from epochs where epoch is not null and (sid is null or epoch_sid is null or sid = epoch_sid)
), changes as (
  select ticker, epoch, epoch as ord, side, price, qty as change from seeds union all select ticker, epoch, ord, side, price, delta from live
), sums as (
  select *, sum(change) over (partition by ticker, epoch, side, price order by ord) as total from changes
), levels as (
  select ticker, epoch, ord, side, price, change, total - least(0, min(total) over (partition by ticker, epoch, side, price order by ord)) as qty from sums
), states as (
  select *, lead(ord) over (partition by ticker, epoch, side, price order by ord) as until from levels
), moments as (
  select distinct ticker, epoch, ord from changes
), resting as (
  select m.ticker, m.epoch, m.ord, s.side, s.price, s.qty from moments m join states s on s.ticker = m.ticker and s.epoch = m.epoch and s.ord <= m.ord and (s.until is null or s.until > m.ord) where s.qty > 0
), bests as (
  select ticker, epoch, ord, max(price) filter (side = 'yes') as bid, 100 - max(price) filter (side = 'no') as ask,
    max_by(qty, price) filter (side = 'yes') as bid_size, max_by(qty, price) filter (side = 'no') as ask_size from resting group by all
), allbooks as (
  select m.ticker, m.epoch, m.ord, bid, ask, bid_size, ask_size, ask - bid as spread, ask + bid as mid_x2 from moments m left join bests b on b.ticker = m.ticker and b.epoch = m.epoch and b.ord = m.ord
), firstcross as (
  select ticker, epoch, min(ord) as ord from allbooks where spread < 0 and ord > epoch group by all
), books as (
  select b.* from allbooks b left join firstcross f on f.ticker = b.ticker and f.epoch = b.epoch where f.ord is null or b.ord < f.ord
), tape as (
  select l_partkey as ticker, cast(epoch(l_shipdate) as bigint) as t, l_orderkey * 8 + l_linenumber as ord, l_returnflag as flag,
    1 + cast(floor(l_extendedprice) as bigint) % 99 as price, cast(l_quantity as bigint) as size, l_suppkey from lineitem
), fills as (
  select o_custkey as ticker, o_orderkey as ord, case when o_orderkey % 2 = 0 then 'buy' else 'sell' end as side, 20 + o_orderkey % 61 as price, 1 + o_orderkey % 5 as n,
    cast(o_orderdate as date) - date '1970-01-01' as day from orders
), markets as (
  select c_custkey as ticker, case c_custkey % 3 when 0 then 'yes' when 1 then 'no' end as result, c_mktsegment from customer
)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` as a query, with the SQL that follows the base tables."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLES[name] = f"with {BASE.strip()}" + (body if body.startswith(",") else f"\n{body}")
        return f

    return register
