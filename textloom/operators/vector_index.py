"""Neighbours of vectors within a cosine, by a partitioned index, and greedy clusters of them.

Vectors are dealt to cells, the nearest of a few centres that are fitted on a bounded sample; every vector is in a cell.
Cells are kept in blocks of bounded size, and a block of queries meets a block of vectors as two matrices in one task, so
neither a large cell nor a large table is ever in one task. Which cells a query meets is decided by angles: a vector in a cell of
radius r around a centre cannot be within the angle t of a query that is further than r + t from that centre. That
leaves out nothing; meeting only the nearest few of these cells is the fast way, with a recall below 1.

Equal vectors are one node, so copies make no pairs among themselves. No vector passes through the driver, only centres and cell sizes do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import rounded
from textloom.operators.clusters import leaders
from textloom.operators.datasets import cap_per_group
from textloom.sources.scratch import small, written

#: Vectors that fit the centres: at most so many for each, the first by a hash of their id.
SAMPLE_PER_CELL = 64
MOST_CELLS = 1024
#: Vectors of a cell in the mean, where the number of cells is not given; rows of a block, which holds many cells if all that may be near are to be met; and
#: queries whose cosines are in memory at a time. Each block is shuffled once for each that it meets, so few large ones are shuffled less.
CELL_ROWS = 512
BLOCK_ROWS = 2048
GROUP_ROWS = 32_768
AT_ONCE = 256
_SIDE = "rep long, v array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors (vec_id, embedding) of unit length. Those without id or embedding, with nulls in it, of no length, or of another size than most (of equally many: the larger size) are left out; of an id that comes more often, one is kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    size = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dim"))["dim"].alias("dim"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    v = v.join(F.broadcast(size), F.size("v") == F.col("dim")).withColumn("norm", norm).filter("norm > 0")  # one row
    return v.groupBy("vec_id").agg(F.min(F.transform("v", lambda x: x / F.col("norm"))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def fit_centers(vectors: DataFrame, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of unit length by k-means on the angle, from SAMPLE_PER_CELL * cells vectors (rep, v) at most; in one task, of bounded size."""

    def run(batches):
        parts = [_matrix(b.column(0)) for b in batches if len(b)]
        if not parts:
            return
        x = np.concatenate(parts)
        c = x[:: max(1, len(x) // cells)][:cells]
        for _ in range(rounds):
            own = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
        yield pa.RecordBatch.from_arrays([_lists(c)], names=["v"])

    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_PER_CELL * cells).select("v").coalesce(1)
    return np.array([r["v"] for r in sample.mapInArrow(run, "v array<double>").collect()])  # cells rows


def _assign(centers: np.ndarray):
    """Each vector with its nearest cell and the angle to that centre."""

    def run(batches):
        for b in batches:
            cos = np.clip(_matrix(b.column(1)) @ centers.T, -1, 1) if len(b) else np.zeros((0, 1))
            cell = cos.argmax(1)
            angle = np.arccos(cos[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["rep", "v", "cell", "angle"])

    return run


def _probe(centers: np.ndarray, known: np.ndarray, radius: np.ndarray, reach: float, probes: int | None):
    """The cells that a vector's block has to meet: those that its angle allows, the nearest `probes` of them."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            angle = np.arccos(np.clip(_matrix(b.column(1)) @ centers[known].T, -1, 1))
            may = angle <= radius[None] + reach + 1e-6
            if probes is not None:
                order = np.argsort(angle, axis=1)[:, :probes]
                near = np.zeros_like(may)
                np.put_along_axis(near, order, True, axis=1)
                may &= near
            cell, part = (b.column(i).to_numpy() for i in (2, 3))
            row, other = np.nonzero(may)
            met = np.unique(np.stack([cell[row], part[row], known[other]]), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in met], names=["cell", "part", "other"])

    return run


def _best(least: float, k: int):
    """From a block of queries and a block of vectors: the k of these with the largest cosine to each query, of `least` or more; ties by id."""

    def run(queries, vectors):
        q, v = (_matrix(t.column(3).combine_chunks()) for t in (queries, vectors))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        a, b = (t.column(2).to_numpy() for t in (queries, vectors))
        order = np.argsort(b)
        b, v = b[order], v[order]
        for i in range(0, len(q) if len(v) else 0, AT_ONCE):
            sim = q[i : i + AT_ONCE] @ v.T
            may = sim >= least - 1e-6
            if len(b) > k + 1 and may.sum() > may.size // 16:  # each may be among its own k + 1
                may &= sim >= np.partition(sim, len(b) - k - 1, axis=1)[:, len(b) - k - 1, None] - 2e-6
            row, at = np.nonzero(may)
            near = np.round(sim[row, at], 6)
            own = (near >= least) & (a[i + row] != b[at])
            row, at, near = row[own], at[own], near[own]
            best = np.lexsort((at, -near, row))
            row, at, near = row[best], at[best], near[best]
            few = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((a[i + row[few]], b[at[few]], near[few]))
        return pa.table(dict(zip(("rep", "other", "sim"), map(np.concatenate, zip(*found)))))

    return run


def block_search(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, least: float, k: int) -> DataFrame:
    """(rep, other, sim): the k best of all vectors that a query's block meets. queries (block, rep, v), vectors (other_block, rep, v), pairs (block, other_block)."""
    columns = ["block", "other_block", "rep", "v"]
    left = queries.join(pairs, "block").select(*columns).groupBy("block", "other_block")
    # under names of its own, as both sides may be of one table
    right = vectors.join(pairs, "other_block").select(*(F.col(c).alias(f"v_{c}") for c in columns)).groupBy("v_block", "v_other_block")
    near = left.cogroup(right).applyInArrow(_best(least, k), "rep long, other long, sim double")
    order = Window.partitionBy("rep").orderBy(F.desc("sim"), "other")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("rep", "other", "sim")


def _blocks(sizes: list[int], most: int, together: bool) -> list[tuple[int, int]]:
    """Of each cell its first block and how many it has: cells larger than `most` are dealt to several, others share one as long as they fit, if they may."""
    out, at, held = [], 0, 0
    for n in sizes:
        parts = -(-n // most)
        if not together or parts > 1 or held + n > most:
            at, held = at + (1 if held else 0), 0
        out.append((at, parts))
        if not together or parts > 1:
            at += parts
        else:
            held += n
    return out


def class_neighbours(reps: DataFrame, least: float, k: int, probes: int | None = None, cells: int | None = None) -> DataFrame:
    """(rep, other, sim) of different unit vectors (rep, v): the k nearest of each with a cosine of `least` or more; all of them without `probes`."""
    n = reps.count()
    cells = min(MOST_CELLS, cells or max(1, n // CELL_ROWS))
    centers = fit_centers(reps, cells)
    if not len(centers):
        return reps.select("rep", F.col("rep").alias("other"), F.lit(0.0).alias("sim")).limit(0)
    rows = written(reps.select("rep", "v").mapInArrow(_assign(centers), f"{_SIDE}, cell int, angle double"), "assigned")
    stats = sorted(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect())  # cells rows
    known, radius = np.array([r["cell"] for r in stats]), np.array([r["angle"] for r in stats])
    dealt = _blocks([r["n"] for r in stats], GROUP_ROWS if probes is None else BLOCK_ROWS, probes is None)
    of = lambda i, c: F.element_at(F.create_map(*(F.lit(int(x)) for r, d in zip(stats, dealt) for x in (r["cell"], d[i]))), F.col(c))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), of(1, "cell")).cast("int"))
    met = rows.select("rep", "v", "cell", "part").mapInArrow(_probe(centers, known, radius, float(np.arccos(min(1.0, max(-1.0, least)))), probes), "cell int, part int, other int").distinct()
    others = F.sequence(of(0, "other"), of(0, "other") + of(1, "other") - 1)
    pairs = met.select((of(0, "cell") + F.col("part")).alias("block"), F.explode(others).alias("other_block")).distinct()
    side = rows.select((of(0, "cell") + F.col("part")).alias("block"), "rep", "v")
    return block_search(side, side.withColumnRenamed("block", "other_block"), written(pairs, "met"), least, k)


def neighbours(vectors: DataFrame, least: float = 0.6, k: int = 15, probes: int | None = None, cells: int | None = None) -> DataFrame:
    """(a, b, rank, sim): the k nearest b of each vector a (vec_id, embedding) with a cosine of `least` or more to six digits; itself left out, ties by id.

    Exact without `probes`; with it, a query meets only that many of the nearest cells. See usable() for odd rows. A vector that many
    rows share is searched once, and each of them gets its own list, from lists of k + 1.
    """
    own = written(usable(vectors), "unit")
    rows = own.select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    first = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"))
    members = written(rows.join(small(written(first, "distinct")), ["h1", "h2"]).select("rep", "vec_id"), "members")
    reps = own.join(members.filter("rep = vec_id").select("vec_id"), "vec_id", "left_semi").withColumnRenamed("vec_id", "rep")
    near = written(class_neighbours(written(reps, "reps"), least, k, probes, cells), "near")
    few = cap_per_group(members, "rep", "vec_id", k + 1)
    same = members.select("rep").distinct().select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("sim")).filter(F.lit(least <= 1.0))
    lists = near.unionByName(same).join(few.withColumnRenamed("rep", "other"), "other")
    order = Window.partitionBy("rep").orderBy(F.desc("sim"), "vec_id")
    lists = lists.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1).select("rep", "sim", F.col("vec_id").alias("b"), "at")
    lists = lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("at", "b", "sim"))).alias("list"))  # k + 1 at most
    out = members.join(small(written(lists, "lists")), "rep").select(F.col("vec_id").alias("a"), F.slice(F.filter("list", lambda x: x["b"] != F.col("vec_id")), 1, k).alias("list"))
    return out.select("a", F.posexplode("list").alias("at", "x")).select("a", "x.b", (F.col("at") + 1).alias("rank"), "x.sim")


def vector_clusters(near: DataFrame) -> DataFrame:
    """(leader, vec_id, size, similarity_score) of neighbours (a, b, rank, sim): one row a member of each group, its leader included.

    Vectors go by id. One that no group holds takes all its neighbours that no group holds; with at least one it leads them, and none of
    these goes to another group. similarity_score is the mean cosine of the others to the leader, to three digits.

    A vector leads unless a smaller leader has it as a neighbour. All others go to the smallest leader that has them. Where a list does not
    hold the reverse of a link, a vector that could lead but has nobody to take can itself be taken later: this is settled from such
    vectors up, in as many rounds as they follow each other.
    """
    near = written(near.select("a", "b", "sim"), "near")
    led = leaders(near.filter("a < b").select(F.lit(0).alias("batch"), "a", "b"))
    followers = written(led.select(F.col("member").alias("b")).distinct(), "followers")
    heads = near.select("a").distinct().join(followers.withColumnRenamed("b", "a"), "a", "left_anti")
    taken = near.join(heads, "a", "left_semi").groupBy("b").agg(F.min_by(F.struct("a", "sim"), "a").alias("x")).select("b", "x.a", "x.sim")
    taken = written(taken, "taken")
    groups = taken.join(followers, "b", "left_semi")
    chain = written(taken.join(followers, "b", "left_anti"), "chain")
    while not chain.isEmpty():
        groups = written(groups, "held")
        ready = chain.join(chain.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        empty = ready.join(groups.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        groups = groups.unionByName(empty.select(*groups.columns))
        chain = written(chain.join(ready.select("b"), "b", "left_anti"), "chain")
    groups = written(groups.select(F.col("a").alias("leader"), F.col("b").alias("vec_id"), "sim"), "groups")
    score = groups.groupBy("leader").agg((F.count("*") + 1).alias("size"), rounded(F.avg("sim"), 3).alias("similarity_score"))
    rows = groups.select("leader", "vec_id").unionAll(score.select("leader", F.col("leader").alias("vec_id")))
    return rows.join(score, "leader").select("leader", "vec_id", "size", "similarity_score")


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, rank): the k vectors with the largest cosine to each query vector, that id itself left out; ties by vec_id. A stated set of queries against all vectors, in blocks."""
    blocked = []
    for rows in (queries, vectors):
        own = written(usable(rows), "unit")
        parts = max(1, -(-own.count() // BLOCK_ROWS))
        blocked.append((own.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("block"), F.col("vec_id").alias("rep"), "v"), parts))
    (q, n_q), (v, n_v) = blocked
    pairs = q.sparkSession.range(n_q * n_v).select((F.col("id") % n_q).cast("int").alias("block"), F.floor(F.col("id") / n_q).cast("int").alias("other_block"))
    near = block_search(q, v.withColumnRenamed("block", "other_block"), pairs, -2.0, k)
    order: Column = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "other"))
    return near.select(F.col("rep").alias("query_id"), F.col("other").alias("vec_id"), order.alias("rank"))
