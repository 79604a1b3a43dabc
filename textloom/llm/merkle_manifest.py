"""Merkle manifest of a dataset with parent-preimage paths (operator 11).

Rows of one tree are leaves in a fixed order; every `arity` consecutive nodes of a level become the hash of
their concatenated hashes, until one node remains, the subroot; the subroots of all trees, in the order of
their keys, make the root in the same way. What is stored of a parent is its preimage, the concatenated hex
hashes of its children: a child finds its siblings by cutting out its own 64 characters, and the parent's
hash with another child by writing that child over them.

Preimages are kept in blocks, the levels above arity ** height consecutive nodes in one row, so a tree of
ten thousand million leaves is four tiers of blocks. Each block gets the path of its root once, from the
tiers above; a leaf joins one row, that of its block. Places in a tree come from a range sort, whose ranges
are counted and numbered by Spark, so no tree, however large, is ever in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import read_table, small_side, written

HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The low bits of monotonically_increasing_id(): the place of a row in its partition.
_PLACE_BITS = 33
_STEP = "array<struct<preimage:string,slot:int>>"


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes of the value as text, a colon, and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_key(value: Column) -> Column:
    """A text that sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def excise(preimage: Column, slot: Column) -> Column:
    """The siblings: a preimage without the hash in that slot."""
    return F.concat(F.substring(preimage, F.lit(1), slot * HEX), F.substring(preimage, slot * HEX + (HEX + 1), F.length(preimage)))


def splice(preimage: Column, slot: Column, hash_: Column) -> Column:
    """A preimage with another hash in that slot."""
    return F.concat(F.substring(preimage, F.lit(1), slot * HEX), hash_, F.substring(preimage, slot * HEX + (HEX + 1), F.length(preimage)))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: excise(s["preimage"], s["slot"])), "")


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(splice(s["preimage"], s["slot"], h), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with pos, the place from 0 among the rows of the tree by `order` (nulls first), and n, the rows of the tree.

    Equal rows keep different places. Only one row a tree and range is counted.
    """
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    ranges = placed.groupBy("tree", F.shiftright("at", _PLACE_BITS).alias("range")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("tree", "range", (earlier - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    out = placed.withColumn("range", F.shiftright("at", _PLACE_BITS)).join(small_side(ranges, "ranges"), ["tree", "range"])
    return out.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


@dataclass
class Tree:
    """Blocks of preimages, a table a tier: (tree, n, block, levels, hash), n the nodes that the tree has on the lowest level of that tier."""

    tiers: list[DataFrame]
    arity: int
    height: int

    @property
    def width(self) -> int:
        return self.arity**self.height

    @property
    def roots(self) -> DataFrame:
        """(tree, hash): what remains of each tree."""
        found = None
        for tier in self.tiers:
            part = tier.filter(F.col("n") <= self.width).select("tree", "hash")
            found = part if found is None else found.unionAll(part)
        return found

    def within(self, levels: Column, place: Column) -> Column:
        """The path of the node at that place of a block, up to the root of the block."""
        up = lambda level: F.floor(place / F.pow(F.lit(float(self.arity)), level)).cast("int")  # noqa: E731 - whole numbers below 2**53
        step = lambda preimages, level: F.struct(F.get(preimages, F.floor(up(level) / self.arity).cast("int")).alias("preimage"), (up(level) % self.arity).alias("slot"))
        return F.transform(levels, step).cast(_STEP)

    def blocks(self, above: DataFrame) -> DataFrame:
        """(tree, block, levels, above, root, ...) of the lowest tier; above has the path that goes on from each tree's root, and columns to carry along."""
        carried = [c for c in above.columns if c != "tree"]
        upper = None
        for tier in reversed(self.tiers):
            here = tier.filter(F.col("n") <= self.width).withColumnRenamed("hash", "root").join(above, "tree").select("tree", "block", "levels", "root", *carried)
            if upper is not None:
                over = upper.select("tree", F.col("block").alias("over"), F.col("levels").alias("over_levels"), "root", *carried)
                below = tier.filter(F.col("n") > self.width).withColumn("over", F.floor(F.col("block") / self.width)).drop("hash").join(over, ["tree", "over"])
                path = F.concat(self.within(F.col("over_levels"), F.col("block") % self.width), F.col("above"))
                here = here.unionByName(below.select("tree", "block", "levels", "root", *(path.alias(c) if c == "above" else F.col(c) for c in carried)))
            upper = here
        return upper


def build(nodes: DataFrame, arity: int = 2, height: int = 8) -> Tree:
    """A forest over nodes (tree, pos, n, hash)."""
    width, tiers = arity**height, []

    def raise_(state: Column, _: Column) -> Column:
        last = F.floor((F.size(state["nodes"]) - 1) / arity).cast("int")
        preimages = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(state["nodes"], i * arity + 1, F.lit(arity)), ""))
        return let(preimages, lambda p: F.struct(F.transform(p, lambda x: F.sha2(x, 256)).alias("nodes"), F.concat(state["levels"], F.array(p)).alias("levels")))

    n_levels = sum(((F.col("n") > arity**i).cast("int") for i in range(height)), F.lit(0))
    rounds = F.when(n_levels > 0, F.sequence(F.lit(1), n_levels)).otherwise(F.array().cast("array<int>"))
    while True:
        grouped = nodes.groupBy("tree", "n", F.floor(F.col("pos") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("nodes"))  # width nodes at most
        start = F.struct(F.col("nodes.hash").alias("nodes"), F.array().cast("array<array<string>>").alias("levels"))
        tier = grouped.select("tree", "n", "block", F.aggregate(rounds, start, raise_).alias("up"))
        tiers.append(written(tier.select("tree", "n", "block", "up.levels", F.get("up.nodes", 0).alias("hash")), "tier"))
        nodes = tiers[-1].filter(F.col("n") > width).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), "hash")
        if nodes.isEmpty():
            return Tree(tiers, arity, height)


def manifest(rows: DataFrame, *, tree: str = "lang", order: tuple[str, ...] = ("doc_id",), leaf: str = "leaf", arity: int = 2, height: int = 8) -> DataFrame:
    """The columns of rows (row.*) as a struct `row`, with subroot, root and path, an array of (preimage, slot) from the leaf to the root.

    rows: one row a leaf, with its hash in `leaf`. Leaves of a tree go by `order`, nulls first, then by hash, so equal rows
    have different places and any of them has any of these. Null keys are a tree, the first. Other columns pass through
    under any name, as they are in the struct. Without rows there is no root and no row.
    """
    ids = [f"_order{i}" for i in range(len(order))]
    nodes = rows.select(tree_key(F.col(tree)).alias("tree"), *(F.col(c).alias(i) for c, i in zip(order, ids)), F.col(leaf).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    leaves = written(numbered(nodes, [*ids, "hash"]).select("tree", "pos", "n", "hash", "row"), "leaves")
    trees = build(leaves.drop("row"), arity, height)
    subroots = numbered(trees.roots.select("tree", "hash").withColumnsRenamed({"tree": "name"}).withColumn("tree", F.lit("")), ["name"])
    subroots = written(subroots, "subroots")
    top = build(subroots.select("tree", "pos", "n", "hash"), arity, height)
    over = top.blocks(top.roots.select("tree", F.array().cast(_STEP).alias("above")))
    joined = subroots.withColumn("block", F.floor(F.col("pos") / top.width)).join(over, ["tree", "block"])
    above = joined.select(F.col("name").alias("tree"), F.concat(top.within(F.col("levels"), F.col("pos") % top.width), F.col("above")).alias("above"), F.col("root").alias("top"))
    blocks = trees.blocks(above)
    found = leaves.withColumn("block", F.floor(F.col("pos") / trees.width)).join(blocks, ["tree", "block"])
    path = F.concat(trees.within(F.col("levels"), F.col("pos") % trees.width), F.col("above"))
    return found.select("row", F.col("root").alias("subroot"), F.col("top").alias("root"), path.alias("path"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, digest of the proof, and the root folded from a leaf that may be tampered with, of all documents.

    Null ids come first and are not tampered with; documents without n_chars cannot be. Repeated ids go by the hash of the row.
    """
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    whole = [F.col(c) for c in FIELDS]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf_hash(*whole).alias("leaf"), F.when(hit, leaf_hash(*changed)).alias("tampered"))
    found = manifest(rows)
    shown = F.coalesce("row.tampered", "row.leaf")
    once = let(F.col("path"), lambda p: F.struct(F.sha2(proof(p), 256).alias("proof_sha256"), fold(p, shown).alias("folded_root")))
    return found.select("row.doc_id", "row.leaf", "subroot", "root", once.alias("out")).select(
        "doc_id", "leaf", "subroot", "root", "out.proof_sha256", "out.folded_root", (F.col("out.folded_root") == F.col("root")).alias("verified")
    )


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"
# the bits of a CRC-32 one by one
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, range(0, 8 * strlen(s))), lambda c, i:
  xor((CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, CAST(i // 8 AS INTEGER) + 1, 1)) AS BIGINT)) ELSE c END) >> 1,
  3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, CAST(i // 8 AS INTEGER) + 1, 1)) AS BIGINT)) ELSE c END) & 1))))"""

ORACLE = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '') AS t, leaf, CASE WHEN {_CRC} % 7 = 0 THEN tampered ELSE leaf END AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s, {_LEAF('n_chars')} AS leaf, {_LEAF('(n_chars + 1)')} AS tampered FROM documents)),
g AS (SELECT t, 0 AS level, pos, leaf AS h FROM l
  UNION ALL SELECT t, level, pos, h FROM (SELECT t, level + 1 AS level, pos // 2 AS pos, pos % 2 AS side,
    sha256(h || coalesce(lead(h) OVER (PARTITION BY t ORDER BY pos), '')) AS h, count(*) OVER (PARTITION BY t) AS n FROM g) WHERE n > 1 AND side = 0),
top AS (SELECT t, max(level) AS level FROM g GROUP BY t),
s AS (SELECT g.t, g.h, row_number() OVER (ORDER BY g.t) - 1 AS pos FROM g JOIN top ON top.t = g.t AND top.level = g.level),
r AS (SELECT 0 AS level, pos, h FROM s
  UNION ALL SELECT level, pos, h FROM (SELECT level + 1 AS level, pos // 2 AS pos, pos % 2 AS side,
    sha256(h || coalesce(lead(h) OVER (ORDER BY pos), '')) AS h, count(*) OVER () AS n FROM r) WHERE n > 1 AND side = 0),
p AS (SELECT t, pos AS leaf_pos, 0 AS level, pos, shown AS h, '' AS sibs FROM l
  UNION ALL SELECT p.t, p.leaf_pos, p.level + 1, p.pos // 2, sha256(CASE WHEN p.pos % 2 = 0 THEN p.h || coalesce(g.h, '') ELSE g.h || p.h END), p.sibs || coalesce(g.h, '')
  FROM p JOIN top ON top.t = p.t AND p.level < top.level LEFT JOIN g ON g.t = p.t AND g.level = p.level AND g.pos = xor(p.pos, 1)),
q AS (SELECT p.t, p.leaf_pos, 0 AS level, s.pos, p.h, p.sibs FROM p JOIN top ON top.t = p.t AND top.level = p.level JOIN s ON s.t = p.t
  UNION ALL SELECT q.t, q.leaf_pos, q.level + 1, q.pos // 2, sha256(CASE WHEN q.pos % 2 = 0 THEN q.h || coalesce(r.h, '') ELSE r.h || q.h END), q.sibs || coalesce(r.h, '')
  FROM q LEFT JOIN r ON r.level = q.level AND r.pos = xor(q.pos, 1) WHERE q.level < (SELECT max(level) FROM r))
SELECT l.doc_id, l.leaf, s.h AS subroot, root.h AS root, sha256(q.sibs) AS proof_sha256, q.h AS folded_root, q.h = root.h AS verified
FROM l JOIN s ON s.t = l.t JOIN q ON q.t = l.t AND q.leaf_pos = l.pos AND q.level = (SELECT max(level) FROM r) CROSS JOIN (SELECT h FROM r ORDER BY level DESC LIMIT 1) AS root
"""
