"""Versioned table snapshots: a new version is written whole, then the pointer moves, so readers see old or new and never half."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a temporary one only where that is unset on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint_ready(spark: SparkSession) -> None:
    """Makes checkpoint() usable."""
    shared_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and its size is that of its files."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/part-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def commit(df: DataFrame, table: str) -> str:
    """Writes a version under `table` and points to it; returns the version's path."""
    at = f"{table}/v-{time.time_ns()}"
    df.write.parquet(at)
    df.sparkSession.createDataFrame([(at, time.time_ns())], "path string, stamp long").coalesce(1).write.mode("append").parquet(f"{table}/_log")
    return at


def current(spark: SparkSession, table: str) -> DataFrame:
    path = spark.read.parquet(f"{table}/_log").agg(F.max_by("path", "stamp")).first()[0]
    return spark.read.parquet(path)
