"""Exact deduplication as a stateful stream with disk-backed keyed state.

Two streaming queries keep an index in a folder.  The first writes an arrival per row: doc_id, digest of the
normalised text and the locator of its content (file and row in the file).  The second reads the arrivals
and holds, per digest, the number of rows and the row that stays, in a RocksDB state store without expiry.
The state is read back by Spark's state reader.  Rows whose digest was there before are hits: their whole
texts are compared before they count as copies, and digests that prove to have several texts are grouped
again by the text itself.
"""
from __future__ import annotations

import string
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

#: Buckets of 32,768 bits in the broadcast filter of hits: 4 KB each, so 8 MB at most.
FILTER_BUCKETS = 2048
_BUCKET_BITS = 1 << 15
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else megabytes per partition, however few its keys
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}


def normalised(text: Column) -> Column:
    """``text`` (null: empty) with A-Z lower-cased and nothing else changed."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)) \
            .otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


@contextmanager
def _state_store(spark: SparkSession):
    old = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _place() -> tuple[Column, Column]:
    return F.col("_metadata.file_path"), F.col("_metadata.row_index")


class Index:
    """Index of the rows of the Parquet table at ``path``, kept in ``folder`` (shared storage).

    ``update`` takes in the files that are new since the last call; a stopped update goes on where its
    checkpoint is.  ``key`` shortens the digest to the state's key (tests force clashes with it).
    """

    def __init__(self, spark: SparkSession, path: str, folder: str, key=lambda digest: digest):
        self.spark, self.path, self.key = spark, path, key
        self.at = {name: f"{folder}/{name}" for name in ("arrivals", "arrivals-checkpoint", "state-checkpoint")}

    def update(self, max_files: int | None = None) -> None:
        """Take in new files, ``max_files`` in a micro-batch (all that are there if None)."""
        spark = self.spark
        schema = spark.read.parquet(self.path).schema
        read = spark.readStream.schema(schema)
        if max_files:
            read = read.option("maxFilesPerTrigger", max_files)
        # as a pattern, since a stream takes a single file only by a pattern
        rows = read.parquet(f"{self.path[:-1]}[{self.path[-1]}]")
        file, row = _place()
        arrivals = rows.select(F.col("doc_id").cast("long").alias("doc_id"), sha256(F.col("text")).alias("digest"),
                               file.alias("file"), row.alias("row"))
        arrivals.writeStream.format("parquet").option("checkpointLocation", self.at["arrivals-checkpoint"]) \
                .trigger(availableNow=True).start(self.at["arrivals"]).awaitTermination()
        read = spark.readStream.schema(arrivals.schema)
        if max_files:
            read = read.option("maxFilesPerTrigger", max_files)
        state = read.parquet(self.at["arrivals"]).groupBy(self.key(F.col("digest")).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("stays"))
        with _state_store(spark):
            state.writeStream.format("noop").outputMode("update") \
                 .option("checkpointLocation", self.at["state-checkpoint"]).trigger(availableNow=True).start().awaitTermination()

    def arrivals(self) -> DataFrame:
        """doc_id, digest, file and row of every row taken in, with the state's key."""
        return self.spark.read.parquet(self.at["arrivals"]).withColumn("key", self.key(F.col("digest")))

    def groups(self) -> DataFrame:
        """The state: key, n and the row that stays (doc_id, file, row) of every digest."""
        with _state_store(self.spark):
            state = self.spark.read.format("statestore").load(self.at["state-checkpoint"])
        key, = state.schema["key"].dataType.fieldNames()
        n, stays = state.schema["value"].dataType.fieldNames()
        return state.select(F.col("key")[key].alias("key"), F.col("value")[n].alias("n"), F.col("value")[stays].alias("stays"))

    def _texts(self, hits: DataFrame) -> DataFrame:
        """Normalised texts of ``hits(file, row)`` and, at times, of a few other rows.

        The other rows are sorted out before texts are shuffled, by a bitmap of row names of fixed size.
        """
        def spot(file, row):
            return F.pmod(F.xxhash64(file, row), F.lit(FILTER_BUCKETS * _BUCKET_BITS))

        bits = hits.select(spot("file", "row").alias("spot")).groupBy(
            (F.col("spot") / _BUCKET_BITS).cast("int").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod("spot", F.lit(_BUCKET_BITS)) + 1)).alias("bits"))
        file, row = _place()
        rows = self.spark.read.parquet(self.path).select("text", file.alias("file"), row.alias("row")) \
                   .withColumn("spot", spot("file", "row")).withColumn("bucket", (F.col("spot") / _BUCKET_BITS).cast("int"))
        # bit number spot % 32768 of the bucket: byte from the left, then bit from the right
        hit = F.expr("(conv(hex(substring(bits, cast(pmod(spot, 32768) div 8 as int) + 1, 1)), 16, 10)"
                     " >> cast(pmod(spot, 8) as int)) & 1 = 1")
        return rows.join(F.broadcast(bits), "bucket").where(hit).select(normalised(F.col("text")).alias("text"), "file", "row")

    def clashes(self, hits: DataFrame) -> DataFrame:
        """Keys of ``hits(file, row)`` under which whole texts differ, byte by byte.

        Least and greatest text of a key are equal only if all its texts are; every task sends one pair of
        texts per key, however many copies it has.
        """
        texts = self._texts(hits)
        return texts.groupBy(self.key(F.unhex(F.sha2("text", 256))).alias("key")).agg(
            F.min("text").alias("least"), F.max("text").alias("greatest")).where("least <> greatest").select("key")

    def result(self) -> DataFrame:
        """Per row taken in: doc_id, keep_id, group_size, kept, digest, keep_file, keep_row.

        Of equal normalised texts the row with the largest doc_id stays; null is smaller than any doc_id,
        and of rows with the same doc_id the one with the greatest locator stays.
        """
        rows = keep(self.arrivals().join(self.groups(), "key"), "exact-rows")
        hits = rows.where("n > 1").select("file", "row")
        clashed = keep(self.clashes(hits), "exact-clashes")
        if not clashed.isEmpty():
            inside = rows.join(clashed, "key", "left_semi").drop("n", "stays")
            texts = inside.join(self._texts(hits), ["file", "row"])
            groups = texts.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"),
                                                      F.max(F.struct("doc_id", "file", "row")).alias("stays"))
            again = texts.join(groups, ["key", "text"]).drop("text")
            rows = rows.join(clashed, "key", "left_anti").unionByName(again)
        stays = F.col("stays")
        return rows.select(
            "doc_id", stays["doc_id"].alias("keep_id"), F.col("n").cast("long").alias("group_size"),
            ((F.col("file") == stays["file"]) & (F.col("row") == stays["row"])).alias("kept"), "digest",
            stays["file"].alias("keep_file"), stays["row"].alias("keep_row"))


def oracle_sql() -> str:
    """DuckDB twin of the registered query."""
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)"""
