"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWNER: ContextVar[Scope | None] = ContextVar("owner", default=None)


class Scope:
    """Owns the scratch folders that are made inside its `with` block, in its thread and by nobody else; delete() removes them, when nothing is to be read from them any more."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        self._token = _OWNER.set(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNER.reset(self._token)

    def delete(self, spark: SparkSession) -> None:
        conf = spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


#: Rows up to which the smaller side of a join is broadcast; beyond, that join is shuffled.
BROADCAST_ROWS = 100_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir). Where that is unset, a local folder serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"
    if owner := _OWNER.get():
        owner.paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has no more than `most` rows; counts it, so give it a written table."""
    return F.broadcast(df) if df.count() <= most else df
