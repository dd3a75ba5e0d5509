"""Spark session construction and shared-folder handling."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Defaults tuned for local tests; on a cluster the submitter's settings win
# because ``getOrCreate`` keeps an existing session untouched.
_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
}


#: Intermediate tables that still exist.
_TABLES: list[str] = []


def get_spark(master: str | None = None, app: str = "riskframe", **conf) -> SparkSession:
    """Return (or create) a session; local defaults only apply to a new local session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**_LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the submitter and must be on shared storage; an unset
    one is an error there, since executors could not read each other's files.  On a local master,
    as in tests, a scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master!r}")
        d = tempfile.mkdtemp(prefix="riskframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as a Parquet table in the shared checkpoint folder and reading it back.

    Unlike an eager reliable ``checkpoint()`` of an unpersisted plan, the plan is
    computed once; readers get column pruning and predicate pushdown; the files
    live on the shared storage named by ``spark.checkpoint.dir`` and survive the
    loss of any executor.
    """
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that :func:`materialize` wrote; call it when a job's results are stored."""
    n = len(_TABLES)
    while _TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
