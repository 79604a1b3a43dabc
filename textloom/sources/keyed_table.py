"""A stored table with one row a key that takes changes: only the buckets that they touch are written anew.

A version of the table is a manifest: which folder holds each bucket, and the last batch of each writer. A change writes the touched buckets
into a new folder and then puts the next manifest in place by one rename; until then readers see the version before, so a job
that dies in between leaves nothing but an unused folder. A writer that names its batches has each applied once.
The table takes one writer at a time: of two that start from one version, the second fails, as its manifest is already there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_bucket"


class KeyedTable:
    """Rows by `keys` under path. combine(rows) gives one row a key of old and new rows, which have `_new` 0 and 1."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], combine: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.keys, self.combine, self.buckets = spark, path.rstrip("/"), keys, combine, buckets
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    # ---- files -----------------------------------------------------------------------------------------------------------

    def _at(self, name: str):
        """(file system, path) of a name under the table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self) -> dict:
        """The newest version: {version, folders (a bucket's folder), batches (the last one of each writer)}; a name of each bucket at most."""
        found = [n for n in self._names("manifests") if n.endswith(".json")]
        if not found:
            return {"version": 0, "folders": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{found[-1]}", wholetext=True).first()[0])

    def _put(self, manifest: dict) -> None:
        name = f"manifests/{manifest['version']:012d}.json"
        fs, draft = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, path = self._at(name)
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: another writer has made version {manifest['version']}")

    def clean(self) -> list[str]:
        """Delete what no current bucket is in, and older manifests; for when no reader of an older version is left. Returns the folders."""
        now = self.manifest()
        used = set(now["folders"].values())
        gone = [n for n in self._names("data") if n not in used]
        for name in [f"data/{n}" for n in gone] + [f"manifests/{n}" for n in self._names("manifests") if n != f"{now['version']:012d}.json"]:
            fs, path = self._at(name)
            fs.delete(path, True)
        return gone

    # ---- rows ------------------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[str, str], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{f}/{_BUCKET}={b}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        return self._read(self.manifest()["folders"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of those keys, from their buckets alone."""
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        return self._read(self.manifest()["folders"], touched).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def applied(self, writer: str, batch: int) -> bool:
        return self.manifest()["batches"].get(writer, -1) >= batch

    def upsert(self, changes: DataFrame, writer: str | None = None, batch: int | None = None, before_swap: Callable[[], None] | None = None) -> bool:
        """Combine changes into the table; false if that batch of the writer is in it already. Keys are compared with null as a value of its own.

        before_swap is called when all is written but not yet visible.
        """
        now = self.manifest()
        if writer is not None and now["batches"].get(writer, -1) >= batch:
            return False
        new = changes.select(*(F.col(c).cast(t.dataType).alias(c) for c, t in zip(self.schema.names, self.schema))).withColumn(_BUCKET, self._bucket())
        folder, rows = f"v{now['version'] + 1:012d}-{uuid.uuid4().hex[:8]}", new.drop(_BUCKET).withColumn("_new", F.lit(1))
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]  # as many as buckets at most
        if touched:
            old = self._read(now["folders"], touched).withColumn("_new", F.lit(0))
            merged = self.combine(old.unionByName(rows)).select(*self.schema.names).withColumn(_BUCKET, self._bucket())
            merged.write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}")
        if before_swap:
            before_swap()
        left = {int(n.split("=")[1]) for n in self._names(f"data/{folder}") if n.startswith(f"{_BUCKET}=")}
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | {str(b): folder for b in left}
        self._put({"version": now["version"] + 1, "folders": folders, "batches": now["batches"] | ({writer: batch} if writer is not None else {})})
        return True


def newest(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """Of each key the row with the largest order (nulls first); of equal ones the new one. Fields of rows that are equal in both are taken from one row, the largest."""

    def combine(rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "_new"]
        best = F.max(F.struct(F.col(order).isNotNull().alias("k"), F.col(order).alias("o"), "_new", F.struct(*columns).alias("row")))
        return rows.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(best.alias("b")).select("b.row.*")

    return combine


def summed(keys: list[str], sums: list[str], largest: list[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Counters: of each key the sums of some columns and the largest value of others."""
    return lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in largest))
