"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a session on one machine uses the
    warehouse's folder; on a cluster that is an error, for there is no shared folder to guess."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends here."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if it is counted to hold at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pieces(rows: int, most: int = 200_000) -> int:
    """In how many partitions rows are dealt out, so that one holds about `most`, however many rows there are."""
    return max(1, -(-rows // most))


@contextmanager
def _conf(spark: SparkSession, new: dict[str, str]) -> Iterator[None]:
    old = {key: spark.conf.get(key, None) for key in new}
    try:
        for key, value in new.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def _parts(spark: SparkSession, parts: int) -> dict[str, str]:
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    return {key: str(max(int(spark.conf.get(key, None) or spark.conf.get(keys[0])), parts)) for key in keys}


@contextmanager
def spread(spark: SparkSession, parts: int) -> Iterator[None]:
    """Steps run inside have at least so many shuffle partitions."""
    with _conf(spark, _parts(spark, parts)):
        yield


@contextmanager
def lean(spark: SparkSession, rows: int) -> Iterator[None]:
    """Steps run inside read short pieces of files and of shuffles, so that what a task aggregates or sorts does not
    grow with the rows that the step shuffles. A group's rows are still summed up before they are moved."""
    small_pieces = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}
    with _conf(spark, _parts(spark, pieces(rows)) | small_pieces):
        yield
