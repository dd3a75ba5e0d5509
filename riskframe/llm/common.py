"""Helpers shared by the text operators: intermediate tables, row keys and Arrow batches."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Text bytes that a numpy kernel handles at once; one longer document is handled alone.
CHUNK_BYTES = 1 << 19
#: Stands for a null doc_id where ids are compared: later than every real id.
NO_ID = (1 << 63) - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the jobs inside are removed when each job ends."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage so that lost executors cost no recomputation, and lets Spark drop the
    shuffle files that made it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    with _shuffle_cleanup(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`keep` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(col: str = "doc_id"):
    """doc_id as a long without nulls, for ordering and joining."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def text_key(col: str = "text"):
    """Name of a text (null as empty): with doc_key it tells rows apart that share a doc_id or have none."""
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")))


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array as one uint8 array, and the offset of each row (nulls are empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (start, end) that hold at most ``limit`` bytes each, or a single longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def runs(values: np.ndarray) -> np.ndarray:
    """Start index of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
