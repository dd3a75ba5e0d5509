"""Skew-safe positions within groups."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Input bytes that one range partition may hold.
PARTITION_BYTES = 128 << 20


def range_partitions(df: DataFrame, target: int = PARTITION_BYTES) -> int:
    """Partitions for a range exchange of ``df``: the session's number, or more if the tables it reads are larger.

    AQE splits no range partition, so the number follows the sizes of the scanned tables, which Spark knows
    before it runs; a task then gets about ``target`` input bytes at any size.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a leaf without statistics claims to be endless
    return max(least, -(-size // target)) if size < 1 << 60 else least


def rank_within(df: DataFrame, key: str, order, partitions: int | None = None) -> DataFrame:
    """Adds ``_rank``: the 0-based position of each row by ``order`` within its ``key``.

    One plan at every size.  Rows are range-partitioned by (key, order), so a huge key spans many
    tasks; the result is stored once, so that both reads see the same partition ids.  A window over
    (partition, key) gives the position inside a partition.  Only the first key of a partition can
    have rows in earlier ones, so the offsets that are broadcast are at most one row per partition.
    Null keys form a group; rows with equal (key, order) take positions in any order.
    """
    from ..session import materialize
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    p = partitions or range_partitions(df)
    r = materialize(df.repartitionByRange(p, F.col(key), *order).withColumn("_pid", F.spark_partition_id()), "segments")
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (r.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_off", F.sum("_cnt").over(before))
                .where(F.col("_off").isNotNull()).select(F.col("_pid").alias("_p"), F.col(key).alias("_k"), "_off"))
    inside = F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order)) - 1
    return (r.withColumn("_in", inside)
             .join(F.broadcast(offsets), (F.col("_pid") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
             .withColumn("_rank", F.col("_in") + F.coalesce(F.col("_off"), F.lit(0)))
             .select(*df.columns, "_rank"))
