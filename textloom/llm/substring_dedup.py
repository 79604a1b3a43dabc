"""Substring dedup over a compacted de Bruijn graph of word windows (operator 3).

A window (k consecutive words of a document) is an edge of the graph. Windows are gathered into
paths by their minimizer, the smallest hash of `core` consecutive words inside the window: the run of
neighbouring windows of a document that share one minimizer occurrence is one path, written as one row
instead of a row per window. All documents that run through a nonbranching path have the same row, so
the smallest document that holds it decides for all windows at once. Only minimizers with more than
one path branch; the first holder of each of their paths is taken back to its source coordinates, where each
of its windows is compared on its own.

Repeated paths that follow each other in a document and in their source alike are compacted into one long
span, and each such span is verified at its source coordinates: the words there have to be the document's, by a
128-bit digest of the words themselves. Paths and windows are found by hashes of 64 and 128 bits before that.

Shuffles: one row per path and document, with all its places there, keyed by minimizer; so a phrase that one document
repeats is one row. Minimizers that are frequent in a sample of documents are dealt
to many groups each; a group drops what repeats inside it, and only its first holders meet those of the
others. So a passage that a third of all documents share is never gathered in one task. The sample decides only
how a key is dealt, never a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import doc_key, read_table, versions, written
from textloom.llm.wordhash import BASE, BASE2, chunks, grams, range_hashes, window_argmin

#: start is the first place of a path in its document, more has the others or is null.
PATHS = "doc long, version long, start int, more array<int>, n int, minimizer long, path long"


def words_of(text: str) -> list[bytes]:
    """bytes.split() splits at exactly the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def _others(place: np.ndarray, lead: np.ndarray) -> pa.Array:
    """For each run of places that begins at a lead: the places after the first, or null."""
    size = np.diff(np.append(lead, len(place))) - 1
    rest = np.delete(place, lead)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rest, pa.int32()), mask=pa.array(size == 0))


def _paths(window: int, core: int):
    w = window - core + 1

    def run(batches):
        for batch in batches:
            doc, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in chunks(batch.column(2).to_pylist(), words_of):
                n = len(c.hashes) - window + 1
                if n <= 0:
                    continue
                owner = c.doc_of_word
                g = grams(c.hashes, core)
                at = window_argmin(g, w)
                starts = np.flatnonzero(owner[:n] == owner[window - 1 :])
                if not len(starts):
                    continue
                at = at[starts]
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                count = np.diff(np.append(first, len(starts)))
                start = starts[first]
                path = range_hashes(c.hashes, start, start + count + window - 1)
                # equal paths of a document together, in order of place; documents of a chunk are in order already
                order = np.argsort(path, kind="stable")
                start, count, path, least = start[order], count[order], path[order], g[at[first]][order]
                local = owner[start]
                lead = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (local[1:] != local[:-1])]))
                place = (start - c.bounds[local]).astype(np.int32)
                row = np.asarray(c.rows)[local[lead]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[row]),
                        pa.array(version[row]),
                        pa.array(place[lead]),
                        _others(place, lead),
                        pa.array(count[lead].astype(np.int32)),
                        pa.array(least[lead].view(np.int64)),
                        pa.array(path[lead].view(np.int64)),
                    ],
                    names=["doc", "version", "start", "more", "n", "minimizer", "path"],
                )

    return run


ASKED = "doc long, version long, whole boolean, start int, n int, h1 long, h2 long"
#: Spans of a source that are asked for in one row.
TOGETHER = 10_000


def _digest(words: list[bytes]) -> tuple[int, int]:
    x = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def _sources(window: int):
    """At the source coordinates: a hash for each window of a branching path, and a digest of the words of each whole span."""

    def run(batches):
        for batch in batches:
            doc, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            asked = batch.column(3).to_pylist()
            texts = batch.column(2).to_pylist()
            for c in chunks(texts, words_of):
                a, b = grams(c.hashes, window), grams(c.hashes, window, BASE2)
                for k, i in enumerate(c.rows):
                    parts = [np.arange(s["start"], s["start"] + s["n"]) for s in asked[i] if not s["whole"]]
                    local = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                    at = local + c.bounds[k]
                    spans = [s for s in asked[i] if s["whole"]]
                    words = words_of(texts[i]) if spans else []
                    found = [_digest(words[s["start"] : s["start"] + s["n"] + window - 1]) for s in spans]
                    h1, h2 = (np.concatenate([x[at].view(np.int64), np.array([f[j] for f in found], np.int64)]) for j, x in enumerate((a, b)))
                    size = len(h1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(size, doc[i])),
                            pa.array(np.full(size, version[i])),
                            pa.array(np.arange(size) >= len(at)),
                            pa.array(np.concatenate([local, [s["start"] for s in spans]]).astype(np.int32)),
                            pa.array(np.concatenate([np.ones(len(at)), [s["n"] for s in spans]]).astype(np.int32)),
                            pa.array(h1),
                            pa.array(h2),
                        ],
                        names=["doc", "version", "whole", "start", "n", "h1", "h2"],
                    )

    return run


def _keep(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            texts, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for text, drop in zip(texts, spans):
                words = words_of(text) if text else []
                removed = 0
                reach = [(s["start"], s["start"] + s["n"] + window - 1, s["h1"], s["h2"]) for s in drop or ()]
                # a span that differs from its source, against its hash, stays
                reach = [(a, b) for a, b, h1, h2 in reach if h1 is None or _digest(words[a:b]) == (h1, h2)]
                if reach:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [a for a, _ in reach], 1)
                    np.add.at(edge, [b for _, b in reach], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                else:
                    kept = b" ".join(words)
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())] + ([pa.array(cols[3], pa.string())] if with_text else []),
                names=[*batch.schema.names[2:], "n_words", "n_removed", "kept_sha256"] + (["kept_text"] if with_text else []),
            )

    return run


def _frequent(base: DataFrame, to_paths, sample: float, hot_share: float) -> DataFrame:
    """(minimizer, hot): those with at least hot_share of all paths of a sample of documents, so 1 / hot_share at most."""
    drawn = base.filter(F.pmod(F.xxhash64("doc", "version"), F.lit(10_000)) < int(sample * 10_000))
    counts = written(drawn.mapInArrow(to_paths, PATHS).groupBy("minimizer").count(), "sampled")
    least = max(8.0, hot_share * (counts.agg(F.sum("count")).first()[0] or 0))
    return counts.filter(F.col("count") >= least).select("minimizer", F.lit(True).alias("hot"))


def compacted(lost: DataFrame) -> DataFrame:
    """Repeated paths (doc, version, start, n, first) as long spans: those that follow each other in the document and in one source are one."""
    inside = Window.partitionBy("doc", "version").orderBy("start")
    goes_on = (
        (F.lag(F.col("start") + F.col("n")).over(inside) == F.col("start"))
        & (F.lag(F.col("first.start") + F.col("n")).over(inside) == F.col("first.start"))
        & (F.lag("first.doc").over(inside) == F.col("first.doc"))
        & (F.lag("first.version").over(inside) == F.col("first.version"))
    )
    begun = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    spans = lost.withColumn("goes_on", goes_on).withColumn("island", begun)
    return spans.groupBy("doc", "version", "island").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("first").alias("first")).drop("island")


def dedup_substrings(
    docs: DataFrame, *, window: int = 13, core: int = 5, hot_share: float = 3e-5, sample: float = 0.03, with_text: bool = True
) -> DataFrame:
    """Remove each word under a `window` of words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and (with_text) kept_text, one row per input row.
    Null and empty texts have no words. Rows that share a doc_id are one document: they don't remove each
    other's words, and each is returned. Null ids are one document behind all others. Other columns are
    ignored. Texts of any length are read whole. hot_share: a minimizer with that share of the paths of a
    sampled document set is dealt out.
    """
    spark = docs.sparkSession
    version, unique = versions(docs)
    base = docs.select(doc_key().alias("doc"), version.alias("version"), "text").filter(F.col("text").isNotNull())
    base = base if unique else base.dropDuplicates(["doc", "version"])
    to_paths = _paths(window, core)
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))

    hot = _frequent(base, to_paths, sample, hot_share)
    paths = base.mapInArrow(to_paths, PATHS).join(F.broadcast(hot), "minimizer", "left").withColumn("hot", F.col("hot").isNotNull())
    paths = paths.withColumn("group", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "version"), F.lit(deal)) + 1).otherwise(0))
    by_minimizer, by_path = (Window.partitionBy("minimizer", "group", *k) for k in ((), ("path",)))
    source = F.struct("doc", "version", "start")
    seen = paths.withColumn("branches", F.min("path").over(by_minimizer) != F.max("path").over(by_minimizer)).withColumn("first", F.min(source).over(by_path))
    found = seen.filter((F.col("first.doc") < F.col("doc")) | F.col("branches") | F.col("hot"))
    found = written(found.select("doc", "version", "start", "more", "n", "first", "hot", *(F.when(F.col("hot"), F.col(c)).alias(c) for c in ("minimizer", "path"))), "paths")

    places = F.explode(F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>")))).alias("start")
    columns = ["doc", "version", places, "n", "first"]
    holders = found.filter("first.doc = doc")
    # the first holders of each group of a frequent minimizer, once a doc_id: at most `deal` rows for a path
    often = holders.filter("hot").drop("first")
    once = often.groupBy("minimizer", "path", "doc").agg(F.min(F.struct("version", "start")).alias("at"))
    decided = once.select("minimizer", "path", "doc", F.min(F.struct("doc", "at.version", "at.start")).over(Window.partitionBy("minimizer", "path")).alias("first"))
    across = often.join(decided, ["minimizer", "path", "doc"])
    lost = found.filter("first.doc < doc").select(*columns).unionByName(across.filter("first.doc < doc").select(*columns))
    alone = holders.filter("NOT hot").select(*columns).unionByName(across.filter("first.doc = doc").select(*columns))

    spans = written(compacted(lost), "spans")
    asked = spans.select(F.col("first.doc").alias("doc"), F.col("first.version").alias("version"), F.col("first.start").alias("start"), "n").distinct()
    many = asked.groupBy("doc", "version").agg(F.count("*").alias("many"))
    asked = asked.join(many, ["doc", "version"]).withColumn("part", F.pmod(F.xxhash64("start", "n"), F.ceil(F.col("many") / TOGETHER)))
    asked = asked.select("doc", "version", "part", F.struct(F.lit(True).alias("whole"), "start", "n").alias("span"))
    asked = asked.unionByName(alone.select("doc", "version", F.lit(0).cast("long").alias("part"), F.struct(F.lit(False).alias("whole"), "start", "n").alias("span")))
    asked = asked.groupBy("doc", "version", "part").agg(F.collect_list("span").alias("spans"))
    sources = base.join(asked, ["doc", "version"]).select("doc", "version", "text", "spans")
    sources = written(sources.mapInArrow(_sources(window), ASKED), "sources")

    windows = sources.filter("NOT whole").drop("whole", "n")
    first = windows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    none = F.lit(None).cast("long")
    more = windows.join(first, ["h1", "h2"]).filter("first < doc").select("doc", "version", F.struct("start", F.lit(1).alias("n"), none.alias("h1"), none.alias("h2")).alias("span"))
    there = sources.filter("whole").select(F.struct("doc", "version", "start").alias("first"), "n", "h1", "h2")
    verified = spans.join(there, ["first", "n"]).select("doc", "version", F.struct("start", "n", "h1", "h2").alias("span"))
    drop = verified.unionByName(more).groupBy("doc", "version").agg(F.collect_list("span").alias("spans"))

    out = docs.select("doc_id", "text", doc_key().alias("doc"), version.alias("version")).join(drop, ["doc", "version"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.select("text", "spans", "doc_id").mapInArrow(
        _keep(window, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; see dedup_substrings() for odd rows."""
    return dedup_substrings(read_table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
d AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM g JOIN m USING (win) WHERE first < doc_id),
l AS (SELECT doc_id, list(p) AS gone FROM d GROUP BY doc_id),
k AS (SELECT w.doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) w
      LEFT JOIN d ON d.doc_id = w.doc_id AND d.p = w.i WHERE d.p IS NULL),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(l.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
