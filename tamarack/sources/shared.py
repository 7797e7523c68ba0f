"""Paths for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below ``spark.checkpoint.dir``, which the driver and all executors share.

    A session on one machine that names no such folder (as in tests) gets a temporary one; a session on a cluster is
    refused, because executors do not see each other's disks. What is written there is the caller's to remove.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tamarack-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tamarack/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back, for one that is costly and read several times."""
    spark = df.sparkSession
    path, schema = fresh_path(spark, name), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
