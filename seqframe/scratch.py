"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, an own folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="seqframe-"))
    return "file://" + _OWN[0]


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost
    executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/seqframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df marked for broadcast if it has at most that many rows; counted no further."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, *by: str, most: int = 500_000) -> DataFrame:
    """df written, counted and dealt by columns into partitions of about `most` rows, so that what a task sorts
    or keeps doesn't grow with the data; left as it is if the session's partitions do."""
    rows = settled(df)
    parts = -(-rows.count() // most)
    return rows.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
