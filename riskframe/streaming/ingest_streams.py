"""Streaming ingestion (STR1-STR3): the per-event ingest endpoints as Structured Streaming jobs.

Each job reads schema'd files with ``readStream``, runs the same validation and
normalisation expressions as the batch operators, and writes with
``foreachBatch``.  Every micro-batch writes into its own ``batch_id=<n>``
directory with ``overwrite``, so a replayed batch (after a failure, or on
restart from the checkpoint) replaces its own output instead of duplicating
it.  Rejected rows go to a dead-letter table with their reasons.
"""
from __future__ import annotations

import os
import zlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.constants import DEFAULT_HASH_SALT
from ..operators import ingest as I
from ..sources.versions import VersionedTable


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(root, f"batch_id={batch_id}"))


def _dead_letter(rows: DataFrame, reason_col: str = "errors") -> DataFrame:
    return rows.withColumn("reasons", F.array_join(reason_col, "; ")).drop(reason_col) \
        .withColumn("rejected_at", F.current_timestamp())


def stream_wearables(spark: SparkSession, source: str, schema: StructType, companies: DataFrame,
                     employees: DataFrame, out: str, dead_letter: str, checkpoint: str,
                     salt: str = DEFAULT_HASH_SALT, key: str = "event_id"):
    """STR1: validate -> normalise -> pseudonymise -> company/employee checks -> append.

    ``companies`` / ``employees`` are static tables (stream-static semi/anti
    joins).  Returns the finished ``StreamingQuery`` (``availableNow`` trigger).
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = I.validate_wearable(I.resolve_payload_aliases(batch))
        valid, rejected = I.split_valid(checked)
        norm = I.normalize_wearable(valid, salt, keep=[key])
        ok, unknown_co = I.require_company(norm, companies)
        emp_ids = employees.select("employee_id")
        good, unknown_emp = I.require_employee(ok, emp_ids)
        _write_batch(good, out, batch_id)
        dl = _dead_letter(rejected.select(key, "errors")).unionByName(
            unknown_co.select(key, F.lit("company_id: unknown company").alias("reasons"),
                              F.current_timestamp().alias("rejected_at"))).unionByName(
            unknown_emp.select(key, F.lit("employee not found: upload roster first").alias("reasons"),
                               F.current_timestamp().alias("rejected_at")))
        _write_batch(dl, dead_letter, batch_id)

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


@contextmanager
def disk_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB on disk, with changes logged per batch."""
    conf = {"spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_seen(events: DataFrame, key: str, order: str, event_time: str | None = None, expiry: str | None = None) -> DataFrame:
    """Streaming state per ``key``: the row of its first micro-batch with the smallest ``order``.

    All rows of a micro-batch carry the batch's own time, which is the same when a batch is replayed.  The state
    holds the smallest (time, order, row) and the largest time of a key, so later copies never change the row,
    and a key is new exactly if both times agree.  Copies are pre-aggregated before the shuffle.  Without
    ``expiry`` keys are kept for good; with it the state of days that lie further back than ``expiry`` behind
    the newest ``event_time`` is dropped, and rows of such days are late and left out.
    """
    keys = [key]
    if expiry:
        events = events.withWatermark(event_time, expiry)
        keys.append(F.window(event_time, "1 day"))
    rest = [c for c in events.columns if c not in (key, order, *([event_time] if expiry else []))]
    held = events.withColumn("_now", F.current_timestamp()).groupBy(*keys).agg(
        F.min(F.struct("_now", order, *rest)).alias("_first"), F.max("_now").alias("_last"))
    return held.select(key, f"_first.{order}", *[f"_first.{c}" for c in rest], (F.col("_first._now") == F.col("_last")).alias("_new"))


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def stream_clinical(spark: SparkSession, source: str, schema: StructType, companies: DataFrame,
                    employees: DataFrame, out: str, dead_letter: str, checkpoint: str,
                    salt: str = DEFAULT_HASH_SALT, key: str = "payload_id", event_time: str | None = None,
                    expiry: str | None = None, max_files: int | None = None):
    """STR2: as STR1 for claims events, exactly-once by the idempotent ``event_id``.

    Known event ids are keyed state on disk (:func:`first_seen`), so a batch costs what its own rows cost,
    whatever is stored already; of copies in a micro-batch the one with the smallest ``key`` is stored.  Stored
    batches lie under the stream's name, which its checkpoint gives.  A stream with a new checkpoint has no
    state yet, so events that other streams stored in ``out`` are left out by an anti join with those alone.
    Rejected rows and rows of unknown companies or employees go to the dead letters, one line per payload.
    """
    def read():
        r = spark.readStream.schema(schema)
        return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(source)

    def known(rows):
        valid, rejected = I.split_valid(I.validate_clinical(rows))
        norm = I.normalize_clinical(valid, salt, keep=[key, *([event_time] if expiry else [])])
        ok, unknown_co = I.require_company(norm, companies)
        good, unknown_emp = I.require_employee(ok, employees.select("employee_id"))
        return good, rejected, unknown_co, unknown_emp

    name = f"stream={zlib.crc32(checkpoint.rstrip('/').encode()):08x}"
    others = [c for c in _children(spark, out) if c.startswith("stream=") and c != name]

    def store(batch: DataFrame, batch_id: int) -> None:
        new = batch.where("_new").drop("_new")
        if others:
            stored = spark.read.parquet(*[os.path.join(out, c) for c in others]).select("event_id")
            new = new.join(stored, "event_id", "left_anti")
        _write_batch(new, os.path.join(out, name), batch_id)

    def reject(batch: DataFrame, batch_id: int) -> None:
        _, rejected, unknown_co, unknown_emp = known(batch)
        lines = _dead_letter(rejected.select(key, "errors"))
        for rows, reason in ((unknown_co, "company_id: unknown company"),
                             (unknown_emp, "employee not found: upload roster first")):
            lines = lines.unionByName(rows.select(key, F.lit(reason).alias("reasons"), F.current_timestamp().alias("rejected_at")))
        _write_batch(lines, os.path.join(dead_letter, name), batch_id)

    with disk_state(spark):
        q = (first_seen(known(read())[0], "event_id", key, event_time, expiry).writeStream.outputMode("update")
             .foreachBatch(store).option("checkpointLocation", os.path.join(checkpoint, "events"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    rejects = (read().writeStream.foreachBatch(reject).option("checkpointLocation", os.path.join(checkpoint, "rejects"))
               .trigger(availableNow=True).start())
    rejects.awaitTermination()
    return q


def roster_table(spark: SparkSession, out: str) -> VersionedTable:
    """The roster that :func:`stream_roster` keeps; company and gender of a person never change."""
    return VersionedTable(spark, out, "employee_id", ("company_id", "gender"))


def stream_roster(spark: SparkSession, source: str, schema: StructType, initial: DataFrame, out: str,
                  dead_letter: str, checkpoint: str, salt: str = DEFAULT_HASH_SALT, order: str = "row_no",
                  max_files: int | None = None):
    """STR3: roster upserts by key, as changes of a versioned table that starts with ``initial``.

    A batch writes the last row per key of its own rows and a manifest; a replayed batch changes nothing.  A
    batch whose predecessor is not in the table is an error: starting anew would lose earlier upserts.
    """
    table = roster_table(spark, out)
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source)
    cols = initial.columns

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0 and (not table.versions() or f"batch-{batch_id - 1}" not in table.manifest()["names"]):
            raise RuntimeError(f"roster version {batch_id - 1} is missing in {out}")
        if batch_id == 0:
            table.commit(initial, "initial")
        valid, rejected = I.split_valid(I.validate_employee(batch))
        norm = I.normalize_employee(valid, salt, keep=[order])
        rest = [c for c in norm.columns if c not in ("employee_id", order)]
        last = norm.groupBy("employee_id").agg(F.max(F.struct(order, *rest)).alias("_last"))
        table.commit(last.select("employee_id", *[f"_last.{c}" for c in rest]).select(*cols), f"batch-{batch_id}")
        _write_batch(_dead_letter(rejected.select(order, "errors")), dead_letter, batch_id)

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_roster(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """The roster written by :func:`stream_roster`, merged on read: the newest version, or an older one."""
    return roster_table(spark, out).read(version)
