"""Line dedup over levelled sorted runs of line hashes (operator 8), DataFrame operations only.

`LineRuns` is a log-structured set of line keys. Each batch of documents is reduced to its distinct
keys, anti-joined with the runs by a merge join on the 128-bit key hash, and what is new becomes a
sorted, bucketed run of level 0. As soon as a level has `fanout` runs they are merged into one run of the
next level, so a set of n batches has at most fanout * log(n) runs. Batches come in the order of
doc_id, so a key that a run holds was first seen in a smaller doc_id.

A key found in a third of all documents is one row of its batch after partial aggregation; only the join
that takes decisions back to the lines meets its copies, and both of its sides are shuffled for that
join, so adaptive execution splits them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import BLANKS, ascii_lower, doc_key, read_table, scratch_path, version_of, written

HASH = ["h1", "h2"]


class LineRuns:
    """Levels of sorted runs of (h1, h2), each a table bucketed and sorted by its hash; as many buckets as the session has shuffle partitions."""

    def __init__(self, spark: SparkSession, *, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"

    def _write(self, keys: DataFrame, level: int) -> None:
        table = f"{self.name}_{level}_{uuid.uuid4().hex[:8]}"
        (
            keys.select(*HASH).repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy(*HASH)
            .option("path", scratch_path(self.spark, "run")).format("parquet").saveAsTable(table)
        )
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(table)

    def add(self, keys: DataFrame) -> None:
        """Add keys that no run holds, then compact each level that is full."""
        self._write(keys, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(reduce(DataFrame.unionAll, map(self.spark.table, full)), level + 1)
            for table in full:
                self.spark.sql(f"DROP TABLE {table}")
            level += 1

    def mark(self, keys: DataFrame) -> DataFrame:
        """keys with `held`: true where a run has the key. Runs are disjoint, so each key meets one at most."""
        out = keys.withColumn("held", F.lit(False))
        for table in (t for level in self.levels for t in level):
            run = self.spark.table(table).withColumn("hit", F.lit(True))
            out = out.join(run, HASH, "left").select(*keys.columns, (F.col("held") | F.col("hit").isNotNull()).alias("held"))
        return out

    def drop(self) -> None:
        """Forget the tables; their files stay in the shared scratch folder with the other intermediate data."""
        for table in (t for level in self.levels for t in level):
            self.spark.sql(f"DROP TABLE {table}")
        self.levels = []


def line_key(line) -> F.Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop lines whose key (stripped, A-Z lower-cased, at least min_chars code points) is in a smaller doc_id.

    Returns the columns of docs with the text left, plus n_lines, n_dropped (long) and kept_sha256; names
    that clash with those three are replaced. A null or empty text is one empty line; its text stays as it is.
    Rows that share a doc_id are one document, null ids one document behind all others. `batches` ranges of
    doc_id pass through the runs one after another; their number changes the work, not the result. Keys are compared by 128-bit hashes.
    """
    spark, version = docs.sparkSession, version_of(docs)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    base = docs.select(doc_key().alias("doc"), version.alias("version"), lines.alias("lines"))
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None
    cuts = sorted(set(cuts or []))
    bounds = [None, *cuts, None]
    runs, hits = LineRuns(spark, fanout=fanout), []
    for low, high in zip(bounds, bounds[1:]):
        inside = F.lit(True) if low is None else F.col("doc") > low
        inside = inside if high is None else inside & (F.col("doc") <= high)
        keys = (
            base.filter(inside)
            .select("doc", "version", F.posexplode(F.transform("lines", line_key)).alias("pos", "key"))
            .filter(F.char_length("key") >= min_chars)
            .select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
        )
        keys = written(keys, "lines")
        distinct = keys.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        marked = written(runs.mark(distinct), "keys")
        runs.add(marked.filter(~F.col("held")))
        decided = marked.filter(F.col("held") | (F.col("first") < F.col("last"))).select(*HASH, "held", "first")
        hits.append(keys.join(decided, HASH).filter(F.col("held") | (F.col("first") < F.col("doc"))).select("doc", "version", "pos"))
    runs.drop()
    gone = reduce(DataFrame.unionAll, hits).distinct().groupBy("doc", "version").agg(F.collect_list("pos").alias("gone"))

    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_sha256")]
    whole = docs.select(*own, doc_key().alias("__doc"), version.alias("__version"))
    gone = gone.withColumnsRenamed({"doc": "__doc", "version": "__version", "gone": "__gone"})
    out = whole.join(gone, ["__doc", "__version"], "left").withColumn("__lines", lines)
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda p: F.get("__lines", p)), "\n")
    )
    out = out.withColumn("text", kept).withColumns(
        {"n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "kept_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}
    )
    out = out.select(*own, "n_lines", "n_dropped", "kept_sha256")
    return out


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and a digest of what is left, of all documents; see dedup_lines() for odd rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS n FROM (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, CAST(max(n) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (WHERE f.first < k.doc_id) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.first IS NULL OR f.first >= k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.doc_id
"""
