"""Scans of the landed Parquet tables."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SCANS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain Parquet scan; column pruning and filter pushdown are left to Catalyst.

    The (lazy) DataFrame handle is reused per session and path, so the file
    listing and footer read happen once on the driver rather than per query.
    """
    key = (id(spark), table_path(sf_dir, name))
    df = _SCANS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(table_path(sf_dir, name))
        _SCANS[key] = df
    return df


def read_tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}
