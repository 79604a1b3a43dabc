"""Exact n-gram Jaccard join with PartEnum signatures (operator 4).

A document's set holds the hashes of its distinct n-word shingles. Sets go into bands of sizes; sets whose
size is close enough to the next band also go there, so two similar sets always share a band, in which
they differ in at most k elements. The hash domain is cut into n1 parts of n2 subparts, with n1 (k2 + 1) > k, so
in some part two similar sets differ in at most k2 elements and agree on n2 - k2 of its subparts. Each choice
of n2 - k2 subparts is a signature: its number and the hash of the set's elements in it. Signatures of too few elements to tell
sets apart are left out where the others suffice (see signatures()).

Equal sets are one node from the start. Round 1 compares the nodes that share a signature with its smallest
and its largest node, so a group of copies yields no more than two candidates a member. Round 2 compares what still
shares a signature but no component. Both joins test a bound on the difference (parity sketches: each differing
element flips one bit) before they emit a pair, and each emitted pair is tested on the whole sets. A pair in
one component after round 1 needs no test, and all others that share a signature are tested: no link is lost.
A signature common to many nodes is split over tasks by adaptive execution, as both sides of the joins are shuffled.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import NO_ID, doc_key, read_table, version_of, written
from textloom.llm.graph import components
from textloom.llm.wordhash import BASE2, chunks, grams, mix, range_hashes

#: Names of documents (16 bytes each) up to which they are broadcast; beyond, that join is shuffled.
BROADCAST_ROWS = 200_000

#: 64-bit words of a parity sketch.
SKETCH = 16
BITS = [f"k{i}" for i in range(SKETCH)]
#: The same for the second test, which distinct candidate pairs pass before their whole sets are fetched.
WIDE = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_sets(batch_texts, width: int):
    """Yield (row, sorted distinct shingle hashes) for each text."""
    for c in chunks(batch_texts, words_of):
        g = grams(c.hashes, width)
        for k, i in enumerate(c.rows):
            a, b = int(c.bounds[k]), int(c.bounds[k + 1])
            if b - a >= width:
                yield i, np.unique(g[a : b - width + 1])
            elif b > a:
                yield i, range_hashes(c.hashes, np.array([a]), np.array([b]))
            else:
                yield i, g[:0]


def parity(s: np.ndarray, words: int) -> np.ndarray:
    """A bit for each of 64 * words classes of hashes: whether the set has an odd number of them."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sets(width: int):
    def run(batches):
        for batch in batches:
            n, s1, s2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            sketch, wide = (np.zeros((batch.num_rows, w), np.uint64) for w in (SKETCH, WIDE))
            for i, s in shingle_sets(batch.column(2).to_pylist(), width):
                n[i], s1[i], s2[i] = len(s), mix(s).sum(), mix(s * BASE2).sum()
                sketch[i], wide[i] = parity(s, SKETCH), parity(s, WIDE)
            columns = [pa.array(n), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (s1, s2, *sketch.T))]
            every = np.arange(0, wide.size + 1, WIDE, dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(every), pa.array(wide.ravel().view(np.int64))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc", "version", "n", "s1", "s2", *BITS, "wide"])

    return run


def bands(size: int, percent: int, steps: int = 3) -> list[tuple[int, int, int]]:
    """(band, its largest size, k) of a set: its own band and, if a larger similar set can be there, the next.

    A band covers sizes in which the largest is about (100 / percent) ** steps of the smallest; k is the
    most elements in which two similar sets of the band can differ.
    """
    edges, out = [1], []
    while edges[-1] <= size:
        edges.append(max(edges[-1] + 1, int(edges[-1] * (100 / percent) ** steps)))
    own = len(edges) - 2
    for band in (own, own + 1):
        low = edges[band]
        top = max(low + 1, int(low * (100 / percent) ** steps)) - 1
        if band == own or 100 * size >= percent * low:
            # |A xor B| <= (1 - t) / (1 + t) (|A| + |B|)
            out.append((band, top, 2 * top * (100 - percent) // (100 + percent)))
    return out


def signatures(s: np.ndarray, percent: int, n2: int = 2, k2: int = 1, spare: float = 0.08) -> np.ndarray:
    """PartEnum signatures of a set of 64-bit hashes, without those of too few elements.

    Subparts that are empty or nearly so are alike in unlike sets. A set knows in how many parts any similar set differs from it
    in k2 elements at most. So it takes the largest m for which one of those parts must have m elements or more in each of its
    choices, and leaves out all signatures of fewer. In that part a similar set has the very elements of the choice that both
    agree on; of two sets the one with the larger m makes sure that neither leaves out that signature. `spare` more parts than
    the method needs let large sets reach m = 1.
    """
    choices = np.array([[i in c for i in range(n2)] for c in combinations(range(n2), n2 - k2)], np.uint64)
    out = []
    value = mix(s ^ BASE2)
    for band, top, k in bands(len(s), percent):
        tag = np.uint64(band << 32)
        if k == 0:  # only equal sets are similar
            out.append(mix(value.sum(keepdims=True) * BASE2 + mix(np.array([5], np.uint64) + tag)))
            continue
        n1 = int((k // (k2 + 1) + 1) * (1 + spare))
        cell = ((s >> np.uint64(20)) % np.uint64(n1 * n2)).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell, value)
        sums = mix(sums + np.uint64(1)).reshape(n1, n2)
        sig = (sums[:, None, :] * choices[None]).sum(axis=2)  # one number for each part and choice
        held = (np.bincount(cell, minlength=n1 * n2).reshape(n1, 1, n2) * choices[None].astype(np.int64)).sum(axis=2)
        differ = min(k, (len(s) + min(top, 100 * len(s) // percent)) * (100 - percent) // (100 + percent))
        agree = n1 - differ // (k2 + 1)
        least = np.sort(held.min(axis=1))[agree - 1]
        x = mix(sig.ravel() * BASE2 + mix(np.arange(sig.size, dtype=np.uint64) + tag + np.uint64(7)))
        out.append(x[held.ravel() >= least])
    return np.concatenate(out)


def _signatures(width: int, percent: int):
    def run(batches):
        for batch in batches:
            sigs, ids = [], []
            for i, s in shingle_sets(batch.column(0).to_pylist(), width):
                if len(s):
                    x = signatures(s, percent)
                    sigs.append(x)
                    ids.append(np.full(len(x), mix(s).sum()))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids).view(np.int64))], names=["sig", "s1"])

    return run


def _elements(width: int):
    def run(batches):
        for batch in batches:
            rows, parts = [], []
            for i, s in shingle_sets(batch.column(2).to_pylist(), width):
                rows.append(i)
                parts.append(s)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            bounds = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            own = [batch.column(j).take(pa.array(rows, pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))], names=["doc", "version", "elements"])

    return run


def _close(percent: int) -> Column:
    """False only where a and b surely differ in more elements than similar sets of their sizes."""
    a, b = ([F.col(f"{x}.{c}") for c in ("n", *BITS)] for x in "ab")
    flips = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:])), F.lit(0))
    return (
        (100 * F.least(a[0], b[0]) >= percent * F.greatest(a[0], b[0]))
        & ((100 + percent) * flips <= (100 - percent) * (a[0] + b[0]))
    )


def links(base: DataFrame, sets: DataFrame, *, width: int, percent: int) -> DataFrame:
    """(a, b): smallest doc of each of two different sets that are similar, enough of them to connect all that are."""
    nodes = written(sets.filter("n > 0").groupBy("n", "s1", "s2", *BITS).agg(F.min("doc").alias("doc"), F.min_by("version", "doc").alias("version")), "nodes")
    # made twice rather than written: they are larger than the texts
    sigs = base.select("text").mapInArrow(_signatures(width, percent), "sig long, s1 long")
    shared = sigs.groupBy("sig").agg(F.min("s1").alias("pivot"), F.max("s1").alias("last")).filter("pivot < last").select("sig", "pivot", "last")
    shared = written(sigs.join(shared, "sig").distinct(), "shared")

    def tested(pairs: DataFrame) -> DataFrame:
        """The pairs of (doc, version) whose whole sets are similar."""
        ends = [F.col("a.doc").alias("a"), F.col("a.version").alias("av"), F.col("b.doc").alias("b"), F.col("b.version").alias("bv")]
        pairs = written(pairs.select(*ends).distinct(), "pairs")
        wide = sets.select("doc", "version", "n", "wide").dropDuplicates(["doc", "version"])

        def beside(df: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
            for x in "ab":
                df = df.join(table.select(F.col("doc").alias(x), F.col("version").alias(f"{x}v"), *(F.col(c).alias(f"{x}_{c}") for c in columns)), [x, f"{x}v"])
            return df

        flips = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        close = (100 + percent) * flips <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
        pairs = written(beside(pairs, wide, "n", "wide").filter(close).select("a", "av", "b", "bv"), "close")
        used = written(pairs.select(F.col("a").alias("doc"), F.col("av").alias("version")).unionAll(pairs.select("b", "bv")).distinct(), "used")
        used = F.broadcast(used) if used.count() <= BROADCAST_ROWS else used
        whole = written(base.join(used, ["doc", "version"]).mapInArrow(_elements(width), "doc long, version long, elements array<long>").dropDuplicates(["doc", "version"]), "elements")
        both = F.size(F.array_intersect("a_elements", "b_elements"))
        similar = 100 * both >= percent * (F.size("a_elements") + F.size("b_elements") - both)
        return beside(pairs, whole, "elements").filter(similar).select("a", "b")

    # the smallest and the largest node of a signature: two rows a member, and few signatures with unlinked nodes after them
    near = shared.select("sig", "s1", F.explode(F.array("pivot", "last")).alias("pivot")).filter("s1 != pivot").select("pivot", F.col("s1").alias("member")).distinct()
    pairs = near.join(nodes.alias("b"), F.col("member") == F.col("b.s1")).join(nodes.alias("a"), (F.col("pivot") == F.col("a.s1")) & _close(percent))
    first = written(tested(pairs), "links")

    joined = components(first)
    placed = nodes.join(joined, nodes.doc == joined.node, "left").select(nodes["*"], F.coalesce("component", "doc").alias("component"))
    open_sigs = shared.join(placed.select("s1", "component"), "s1").groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("sig")
    rows = written(shared.join(open_sigs, "sig").select("sig", "s1").join(placed, "s1"), "open")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.s1") < F.col("b.s1")) & (F.col("a.component") != F.col("b.component")) & _close(percent))
    return first.unionAll(written(tested(pairs), "links"))


def jaccard_join(docs: DataFrame, *, width: int = 3, percent: int = 90) -> DataFrame:
    """Link documents whose sets of `width`-word shingles (A-Z lower-cased) have a Jaccard index >= percent / 100.

    Returns the columns of docs (without those named like the new ones), n_shingles, component_id (the smallest
    doc_id reachable by links, itself included). A text of fewer words than `width` is one shingle; without words
    or text the set is empty and linked with nothing. Rows that share a doc_id are one document with several
    sets; null ids are one document behind all others, whose component_id is null if it links with no other.
    """
    version = version_of(docs)
    base = docs.select(doc_key().alias("doc"), version.alias("version"), "text")
    sets = written(base.mapInArrow(_sets(width), "doc long, version long, n long, s1 long, s2 long, " + ", ".join(f"{c} long" for c in BITS) + ", wide array<long>"), "sets")
    edges = links(base, sets, width=width, percent=percent)
    same = sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"))
    rep = sets.join(same, ["n", "s1", "s2"], "left").select("doc", "version", "n", F.coalesce("rep", "doc").alias("rep"))
    rep = written(rep.distinct(), "rep")
    several = rep.groupBy("doc").agg(F.count("*").alias("c")).filter("c > 1").select("doc")
    joined = components(edges.unionAll(rep.join(several, "doc").filter("doc != rep").select("doc", "rep")))
    found = rep.join(joined, rep.rep == joined.node, "left").select("doc", "version", "n", F.coalesce("component", "rep").alias("component"))
    own = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    keyed = docs.select(*own, doc_key().alias("__doc"), version.alias("__version"))
    out = keyed.join(found.withColumnsRenamed({"doc": "__doc", "version": "__version", "n": "__n", "component": "__component"}), ["__doc", "__version"], "left")
    return out.select(*own, F.col("__n").alias("n_shingles"), F.nullif("__component", F.lit(NO_ID)).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of all documents; see jaccard_join() for odd rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(3, len(ws)) - 1], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 90 * (na.n + nb.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS x, b AS y FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
