"""Benchmark decontamination by winnowing (operator 7).

Both sides are cut into words, hashed, and winnowed: of every w consecutive k-word hashes the smallest is
kept, so each span of k + w - 1 words that both sides hold has a fingerprint in common. Fingerprints are
joined; around each hit the document is read again and every window that contains the hit is compared by a
128-bit hash with the windows of the benchmark (the extension), so all words of every shared window are
found and nothing else. Items with fewer words than a window are one window of their own length; windows of
fewer than k + w - 1 words are winnowed in the same way with a smaller k and w for each such length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import doc_key, read_table, version_of, written
from textloom.llm.wordhash import BASE2, chunks, grams, window_argmin

#: Fingerprints of the benchmark up to which they are broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 500_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Everything that separates words becomes a blank, so that bytes.split() finds the words.
_CLEAN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in _LOWER)


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than \\x00-\\x2F, \\x3A-\\x60 (after lower-casing A-Z) and \\x7B-\\x7F."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def _k_of(length: int) -> int:
    """Words of a fingerprint for windows of that length: half of it."""
    return (length + 1) // 2


def _winnow(hashes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that winnowing keeps, such that each `length` words of a document hold one."""
    k = _k_of(length)
    g = grams(hashes, k)
    at = window_argmin(g, length - k + 1)
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    at = np.unique(at[owner[:n] == owner[length - 1 :]])
    return at, g[at]


def _fingerprints(lengths: list[int]):
    def run(batches):
        for batch in batches:
            doc, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in chunks(batch.column(2).to_pylist(), words_of):
                owner = c.doc_of_word
                for length in lengths:
                    at, g = _winnow(c.hashes, owner, length)
                    row = np.asarray(c.rows)[owner[at]] if len(at) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[row]), pa.array(version[row]), pa.array(np.full(len(at), length, np.int32)), pa.array((at - c.bounds[owner[at]]).astype(np.int32)), pa.array(g.view(np.int64))],
                        names=["doc", "version", "length", "pos", "h"],
                    )

    return run


def _windows(window: int):
    """Every window of each item: its length, a 128-bit hash and the fingerprints that winnowing keeps in it."""

    def run(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            out = []
            for c in chunks(batch.column(1).to_pylist(), words_of):
                for k, i in enumerate(c.rows):
                    h = c.hashes[c.bounds[k] : c.bounds[k + 1]]
                    length = min(window, len(h))
                    if not length:
                        continue
                    a, b = grams(h, length), grams(h, length, BASE2)
                    g = grams(h, _k_of(length))
                    at = window_argmin(g, length - _k_of(length) + 1)
                    out += [(items[i], length, *map(int, x)) for x in zip(a.view(np.int64), b.view(np.int64), g[at].view(np.int64))]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.types[0]), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.int64()) for x in cols[2:])], names=["item_id", "length", "h1", "h2", "h"]
            )

    return run


def _around():
    """All windows of a document that contain one of its hits."""

    def run(batches):
        for batch in batches:
            doc, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            hits = batch.column(3).to_pylist()
            for c in chunks(batch.column(2).to_pylist(), words_of):
                for k, i in enumerate(c.rows):
                    h = c.hashes[c.bounds[k] : c.bounds[k + 1]]
                    for length in sorted({x["length"] for x in hits[i]}):
                        pos = np.array([x["pos"] for x in hits[i] if x["length"] == length])
                        reach = length - _k_of(length)
                        start = np.unique((pos[:, None] - np.arange(reach + 1)).ravel())
                        start = start[(start >= 0) & (start <= len(h) - length)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(start), doc[i])), pa.array(np.full(len(start), version[i])), pa.array(np.full(len(start), length, np.int32)), pa.array(start.astype(np.int32)),
                             pa.array(grams(h, length)[start].view(np.int64)), pa.array(grams(h, length, BASE2)[start].view(np.int64))],
                            names=["doc", "version", "length", "pos", "h1", "h2"],
                        )

    return run


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, version: Column, *, window: int = 10) -> DataFrame:
    """(doc, version, pos, length, item_id set as `items`, null among them): the windows of benchmark items that documents hold.

    doc is the doc_id (nulls last), version as of version_of(). Null texts and ids of the benchmark: no window, an
    item without id. Equal items are all named.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = written(
        benchmark.filter(F.col("text").isNotNull()).select("item_id", "text").mapInArrow(_windows(window), f"item_id {kind}, length int, h1 long, h2 long, h long"), "items"
    )
    marks = items.select("length", "h").distinct()
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # 1 to window
    base = docs.select(doc_key().alias("doc"), version.alias("version"), "text").filter(F.col("text").isNotNull())
    small = items.count() <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)
    prints = base.mapInArrow(_fingerprints(lengths), "doc long, version long, length int, pos int, h long")
    hits = prints.join(side(marks), ["length", "h"]).groupBy("doc", "version").agg(F.collect_set(F.struct("length", "pos")).alias("hits"))
    hits = written(hits, "hits")
    near = base.join(hits, ["doc", "version"]).select("doc", "version", "text", "hits").mapInArrow(_around(), "doc long, version long, length int, pos int, h1 long, h2 long")
    known = items.groupBy("length", "h1", "h2").agg(F.collect_set(F.struct("item_id")).alias("items"))  # in structs, as a set drops nulls
    return near.join(side(known), ["length", "h1", "h2"]).select("doc", "version", "pos", "length", F.col("items.item_id").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """Mark the documents that hold a window of a benchmark item.

    Returns the columns of docs (without those named like the new ones) and n_words, n_hit (words inside any
    occurrence), n_items (items with occurring windows; all without id count as one), items_sha256 (of their ids, sorted
    as strings, comma-joined, without null), contaminated. Null texts have no words. Rows with equal doc_id and text get equal results.
    """
    version = version_of(docs)
    found = written(contaminated_windows(docs, benchmark, version, window=window), "found")
    spots = found.select("doc", "version", "pos", "length").distinct().groupBy("doc", "version").agg(F.collect_list(F.struct("pos", "length")).alias("spots"))
    names = (
        found.select("doc", "version", F.explode("items").alias("item")).select("doc", "version", F.col("item").cast("string")).distinct()
        .groupBy("doc", "version").agg(F.sort_array(F.collect_list("item")).alias("items"), F.count("*").alias("n_items"))
    )
    # windows in order of their start; a word counts for the first window that reaches it
    ordered = F.sort_array("spots")
    step = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["pos"] + s["length"] - F.greatest(s["pos"], a["end"]))).alias("hit"), F.greatest(a["end"], s["pos"] + s["length"]).alias("end")
        ),
        lambda a: a["hit"].cast("long"),
    )
    per_doc = spots.join(names, ["doc", "version"]).select("doc", "version", step.alias("n_hit"), "n_items", "items")
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    own = [c for c in docs.columns if c not in new]
    keyed = docs.select(*own, doc_key().alias("__doc"), version.alias("__version"))
    per_doc = per_doc.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), "n_hit", F.col("n_items").alias("__n_items"), "items")
    clean = ascii_words("text")
    out = keyed.withColumn("n_words", clean).join(per_doc, ["__doc", "__version"], "left")
    return out.select(
        *own, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("__n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


#: Which bytes are of words.
_OF_WORDS = np.frombuffer(_CLEAN, np.uint8) != 0x20


def _count_words(texts: pa.Array) -> pa.Array:
    """Words of each text: the bytes of words that follow none in their text. Null has none."""
    texts = texts.cast(pa.large_binary())
    n = np.zeros(len(texts), np.int64)
    texts = pa.compute.fill_null(texts, b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    full = at[1:] > at[:-1]
    if full.any():
        word = _OF_WORDS[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
        first = (at[:-1] - at[0])[full]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        starts[first] = word[first]
        n[full] = np.add.reduceat(starts, first, dtype=np.int64)
    return pa.array(n)


def ascii_words(column: str) -> Column:
    """Words of the text; letters A-Z are words before lower-casing as after it. Only counts come back: a regex would make an array of the words."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return _count_words(texts)

    return count(column)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and benchmark items of all documents; see decontaminate() for odd rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).drop("text")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
