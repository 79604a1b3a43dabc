"""Shared helpers of the training-data operators: table access and intermediate tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.scratch import scratch_path, written  # noqa: F401 - operators take them from here

#: Sorts rows without an id behind all others; they count as one document with no id.
NO_ID = (1 << 63) - 1

#: Groups (of language and source, or of source) whose limits or rates are broadcast; beyond, that join is shuffled.
BROADCAST_GROUPS = 100_000

#: The characters that separate words, and that are stripped from lines.
BLANKS = " \t\n\x0b\f\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(where each text of an Arrow array starts, and the last one ends, its UTF-8 bytes) without a copy of each text; a null text is empty."""
    import pyarrow as pa

    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if offsets else np.zeros(1, np.int64)
    return ends, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, name: str) -> DataFrame:
    """df, written, and broadcast if it has no more than BROADCAST_GROUPS rows."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else unchanged; lower() does the same to pure ASCII and is much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def versions(docs: DataFrame) -> tuple[Column, bool]:
    """(what tells rows apart that share a doc_id, whether no rows do): a hash of the text, or 0 where every doc_id is there once.

    With doc_key() it names a row, or several equal ones; the zeros cost nothing in a shuffle.
    """
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return (F.lit(0).cast("long") if unique else F.xxhash64("text")), unique


def version_of(docs: DataFrame) -> Column:
    return versions(docs)[0]
