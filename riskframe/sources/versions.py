"""Versioned tables on Parquet: base and change files under a manifest, merged on read.

A commit writes only its own rows, as a part partitioned by key bucket, and then a manifest that lists all
parts.  Manifests are numbered and never changed, so older versions stay readable.  A reader merges, per key,
the rows of the parts that are live; compaction rewrites chosen buckets as a new part, below which older parts
no longer count for these buckets.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQ, BUCKET = "_seq", "_bucket"


class MissingVersion(RuntimeError):
    """A version that should be there is not."""


@dataclass(frozen=True)
class VersionedTable:
    """A table at ``root``; with ``key`` rows are merged per key, without it parts are appended.

    ``fixed`` columns keep the value of a key's first row, all others take that of its last row.
    """
    spark: SparkSession
    root: str
    key: str | None = None
    fixed: tuple[str, ...] = ()
    buckets: int = 16

    # ---- manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        """Parts, floors (lowest live version per bucket), columns and commit names of a version (default: the newest)."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else -1)
        if version not in known:
            raise MissingVersion(f"version {version} is missing in {self.root}")
        fs, p = self._fs(f"{self.root}/manifest/{version}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Write a manifest under another name and rename it, which fails if the version is there already."""
        fs, draft = self._fs(f"{self.root}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, target = self._fs(f"{self.root}/manifest/{version}")
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"another commit wrote version {version} of {self.root}")

    # ---- commits

    def _write(self, df: DataFrame, path: str) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)
        df.withColumn(BUCKET, bucket).write.mode("overwrite").partitionBy(BUCKET).parquet(path)

    def commit(self, rows: DataFrame, name: str) -> int:
        """Add ``rows`` as one part and return the version; a ``name`` committed before changes nothing.

        A part left by a commit that did not come to its manifest is written anew.
        """
        now = self.manifest() if self.versions() else {"version": -1, "parts": [], "floors": {}, "names": {}, "schema": None}
        if name in now["names"]:
            return now["names"][name]
        version, part = now["version"] + 1, f"part-{name}"
        self._write(rows, f"{self.root}/{part}")
        schema = now["schema"] or rows.schema.json()
        self._publish(version, {**now, "version": version, "parts": [*now["parts"], [version, part]],
                                "names": {**now["names"], name: version}, "schema": schema})
        return version

    def compact(self, buckets: list[int] | None = None) -> int:
        """Merge the live rows of ``buckets`` (default: all) into one part and return the version."""
        now = self.manifest()
        chosen = list(range(self.buckets)) if buckets is None else buckets
        version = now["version"] + 1
        part = f"compact-{version}-{uuid.uuid4().hex[:8]}"
        self._write(self._merged(self._live(now).where(F.col(BUCKET).isin(chosen))), f"{self.root}/{part}")
        self._publish(version, {**now, "version": version, "parts": [*now["parts"], [version, part]],
                                "floors": {**now["floors"], **{str(b): version for b in chosen}}})
        return version

    # ---- reads

    def _live(self, manifest: dict) -> DataFrame:
        """Rows of the live buckets of every part, with the part's version; dead buckets are not read."""
        from pyspark.sql.types import IntegerType, StructField, StructType
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        schema = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
        out = None
        for version, part in manifest["parts"]:
            live = [b for b in range(self.buckets if self.key else 1) if manifest["floors"].get(str(b), -1) <= version]
            if live:
                rows = self.spark.read.schema(schema).parquet(f"{self.root}/{part}").where(F.col(BUCKET).isin(live)) \
                           .withColumn(SEQ, F.lit(version))
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], schema).withColumn(SEQ, F.lit(0))

    def _merged(self, rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c not in (SEQ, BUCKET)]
        if not self.key:
            return rows.select(*own)
        first = [c for c in own if c in self.fixed]
        last = [c for c in own if c not in self.fixed and c != self.key]
        pairs = [f(F.struct(SEQ, *[F.col(f"`{c}`") for c in cols])).alias(n)
                 for f, n, cols in ((F.min, "_first", first), (F.max, "_last", last)) if cols]
        merged = rows.groupBy(self.key).agg(*pairs) if pairs else rows.select(self.key).distinct()
        return merged.select(*[F.col(f"`{self.key}`") if c == self.key else
                               F.col(f"{'_first' if c in first else '_last'}.`{c}`").alias(c) for c in own])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version`` (default: the newest): one partial and final aggregate per key, no join."""
        return self._merged(self._live(self.manifest(version)))
