"""Small Spark helpers of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of ids up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of checkpoints that ``spark.checkpoint.dir`` names; one of its own only on one machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the application in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, as compressed Parquet, and read again, which ends the lineage.

    Results may still be read from these files when they are computed, so none is deleted here. All of an application's
    lie under its id in the checkpoint folder, which may go once the application has ended.
    """
    return cut_at(df, kept_folder(df.sparkSession, "cut"))


def cut_at(df: DataFrame, path: str) -> DataFrame:
    """As ``cut``, in a folder that the caller may ``remove`` once nothing that reads it is left to run."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """``df`` (a few narrow columns, its lineage cut) with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.count() <= bound else df


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores after those that differ from a column's in case at most."""
    used = {c.lower() for c in taken}
    return [n + "_" * next(k for k in range(len(used) + 1) if (n + "_" * k).lower() not in used) for n in names]


def map_arrow(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` by columns' places, whatever their names: it can't take a name with a dot."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, schema)


def columns(df: DataFrame) -> list[Column]:
    """The table's columns, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids fall in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
