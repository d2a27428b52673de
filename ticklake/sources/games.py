"""Game states and REST dumps: box scores by date, and one JSON document a file."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticklake.functions.game import clock_seconds
from ticklake.sources.frames import read_lines

BOXSCORE = "t_receipt double, frame struct<game struct<gameId string, period int, gameClock string, gameStatus int, homeTeam struct<teamTricode string, score int>, awayTeam struct<teamTricode string, score int>>>"


def read_boxscores(spark: SparkSession, root: str, day: str, days_before: int = 1) -> DataFrame:
    """Game states of a date and of ``days_before`` dates before it, as a late game starts on the day before.

    Files lie in ``root/yyyy/MM/dd`` as JSON lines, gzipped or not. Columns: t_receipt, game_id, home_team, away_team,
    home_score, away_score, period, game_clock, game_status, seconds_left. Dates without files give no rows, lines that
    aren't JSON or hold no game are left out; rows are not deduplicated.
    """
    last = date.fromisoformat(day)
    lines = read_lines(spark, *[f"{root}/{last - timedelta(days=k):%Y/%m/%d}/*" for k in range(days_before + 1)])
    g = F.col("f.frame.game")
    rows = lines.select(F.from_json("value", BOXSCORE).alias("f")).where(g.isNotNull())
    side = lambda s: (g[f"{s}Team"]["teamTricode"].alias(f"{s}_team"), g[f"{s}Team"]["score"].alias(f"{s}_score"))
    (home, home_score), (away, away_score) = side("home"), side("away")
    clock = F.coalesce(g["gameClock"], F.lit(""))
    return rows.select("f.t_receipt", g["gameId"].alias("game_id"), home, away, home_score, away_score, g["period"].alias("period"), clock.alias("game_clock"), g["gameStatus"].alias("game_status"), clock_seconds(g["period"], clock).alias("seconds_left"))


def read_documents(spark: SparkSession, root: str, source: str, dataset: str, schema: str | StructType, records: str | None = None) -> DataFrame:
    """Raw dumps under ``root/source/dataset``, one JSON document a file, with the file of each row.

    A document that is an array gives a row per entry; with ``records`` a row per entry of that array field instead.
    Fields that ``schema`` lacks are dropped, those that a document lacks are null.
    """
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(f"{root}/{source}/{dataset}")
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
    return rows.select(F.explode(records).alias("r"), "file").select("r.*", "file") if records else rows
