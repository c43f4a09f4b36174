"""Shared plumbing: scratch tables, checked broadcasts, text columns as numpy bytes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"

#: Rows up to which a dimension table may be broadcast; the count is taken, never assumed.
BROADCAST_ROWS = 200_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, a session on one machine (master local) uses the warehouse's folder; on a
    cluster there is no folder to guess, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and return the table read back.

    This cuts lineage: a lost executor costs the tasks it ran, not the steps before. zstd keeps the
    scratch folder small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _MADE:
        _MADE[-1].append(out)
    return out


#: The scratch tables made inside each open call of `settle`.
_MADE: list[list[DataFrame]] = []


def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that make() plans, stored; the scratch tables it made on the way are deleted, so that a
    chain of operators needs no more room than its largest."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        plan = make()
    finally:
        _MADE.pop()
    out = materialize(plan, label)
    discard(*made)
    release(out.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what no DataFrame refers to any more: Spark's cleaner removes the shuffle
    files of a finished step only after a collection has found its plan unreachable, and those of a
    large step should not lie beside the next one's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_dimension(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a fact table to a dimension whose size is counted first.

    Up to BROADCAST_ROWS rows it is broadcast; beyond that it is an ordinary shuffled join, whose
    hot keys AQE splits.
    """
    rows = small.limit(BROADCAST_ROWS + 1).count()
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len+1 offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cut a record batch into runs of rows whose text comes to about `most` bytes each."""
    _, offsets = text_buffers(batch.column(column))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, rows) - at)
        at = min(to, rows)


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input cannot clash with working ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of df in one struct named row, beside working columns that cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unboxed(df: DataFrame) -> DataFrame:
    """The columns that `boxed` put away."""
    return df.select("row.*")
