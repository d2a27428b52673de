"""Tables kept in the shared folder of an application, which end a lineage or carry a first pass to a second."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names, which all executors share; only on one machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{sc.applicationId}/{name}-{uuid4().hex}"


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """The rows written once and read again; the files go with the application's folder."""
    path = folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
