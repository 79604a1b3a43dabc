"""Audit of how filters interact, by a subset-zeta transform (operator 13).

A document is reduced to its part and a mask of the filters it fails, so a part has at most 2 ** k counts, whatever its
size. The zeta transform adds up, for every set of filters, the documents whose failures all lie in it: the survivors
of the filters outside. Every figure of every order of the filters is then a difference between two
neighbouring subsets: no order is ever applied to documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import doc_key, read_table, written

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
#: All orders are listed, so k filters give k! * k rows a part.
MOST_FILTERS = 7


def mask_counts(rows: DataFrame, failures: dict[str, Column], part: Column, measures: dict[str, Column]) -> DataFrame:
    """(part, mask, a sum for each measure) of rows; bit i of mask is set where the i-th filter fails (null: passes). Null parts are the empty one."""
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures.values())), F.lit(0))
    keyed = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *(m.cast("long").alias(name) for name, m in measures.items()))
    return keyed.groupBy("part", "mask").agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in measures))


def survivors(counts: DataFrame, k: int, measures: list[str]) -> DataFrame:
    """(part, an array for each measure): at place S, the sum over documents that fail none of the filters in the set S."""
    last = (1 << k) - 1
    cells = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures).alias("v")))).alias("cells"))  # 2 ** k at most
    places, bits = F.sequence(F.lit(0), F.lit(last)), F.array(*(F.lit(1 << b) for b in range(k)))

    def zeta(measure: str) -> Column:
        start = F.transform(places, lambda m: F.coalesce(F.col("cells")[m][measure], F.lit(0).cast("long")))
        add = lambda a, bit: F.transform(a, lambda x, s: x + F.when(s.bitwiseAND(bit) != 0, F.get(a, s.bitwiseXOR(bit))).otherwise(F.lit(0).cast("long")))
        inside = F.aggregate(bits, start, add)  # failures within the set: survivors of its complement
        return F.reverse(inside)

    return cells.select("part", *(zeta(m).alias(m) for m in measures))


def orders(table: DataFrame, names: str, lost: list[str]) -> DataFrame:
    """One row a part, order of the filters and step, of survivors(): kept, removed, redundant, unique_fails, shapley, and what each step loses of other measures.

    table has the arrays `n` and those of `lost`; a measure x gives the column x_lost. names: one letter a filter, bit 0 first.
    """
    k = len(names)
    if k > MOST_FILTERS:
        raise ValueError(f"{k} filters have {factorial(k)} orders; audit {MOST_FILTERS} at most")
    everything = (1 << k) - 1
    bit_of = F.create_map(*(F.lit(x) for i, c in enumerate(names) for x in (c, 1 << i)))
    listed = table.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(names)))))
    steps = listed.select("*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("place", "letter")).withColumns({"step": F.col("place") + 1, "bit": bit_of[F.col("letter")]})
    earlier = F.aggregate(F.split(F.left("filter_order", F.col("place")), "(?<=.)(?=.)"), F.lit(0), lambda a, c: a + F.coalesce(bit_of[c], F.lit(0)))
    steps = steps.withColumn("before", earlier).withColumn("after", F.col("before") + F.col("bit"))
    at = lambda m, s: F.get(F.col(m), s)
    removed = lambda m: at(m, F.col("before")) - at(m, F.col("after"))
    # all sets without the filter, weighted by the orders in which they come before it
    sets = F.filter(F.sequence(F.lit(0), F.lit(everything)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    weights = F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)))
    shapley = F.aggregate(sets, F.lit(0).cast("long"), lambda a, s: a + F.get(weights, F.bit_count(s)) * (at("n", s) - at("n", s.bitwiseOR(F.col("bit")))))
    fails = at("n", F.lit(0)) - at("n", F.col("bit"))
    others = F.lit(everything) - F.col("bit")
    return steps.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), removed("n").alias("removed"), (fails - removed("n")).alias("redundant"),
        (at("n", others) - at("n", F.lit(everything))).alias("unique_fails"), *(removed(m).alias(f"{m}_lost") for m in lost), shapley.alias("shapley"),
    )


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters that read one text: few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 50, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"), "D": text.rlike(r"[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over documents (doc_id, text, source) and labels (doc_id, quality, toxic).

    Null texts are empty ones; null sources are the part ''. Rows without doc_id come behind all others for filter E, have no
    label, and fail E only if a row with an id has their text. Rows that share a doc_id count each; of several labels of an
    id the larger value counts. Extra columns of either table are left out. Without documents there is no row.

    Which row holds a text first is one small row a text (the hash, the least id); it meets the documents by hash and id,
    so a text that a third of all documents share is spread over all tasks.
    """
    text = F.coalesce("text", F.lit(""))
    named = text_failures(F.col("text"))
    rows = docs.select(doc_key().alias("doc"), F.col("source").alias("part"), text.alias("text")).select(
        "doc", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), *(f.alias(c) for c, f in named.items())
    )
    # rows that agree in all that counts are one; without ids there are few
    rows = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "audited")
    first = rows.groupBy("h1", "h2").agg(F.min("doc").alias("doc")).withColumn("first", F.lit(True))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    rows = rows.join(first, ["h1", "h2", "doc"], "left").join(known, "doc", "left")
    failures = {c: F.col(c) for c in named} | {"E": F.col("first").isNull()}
    n = F.col("n")
    counts = mask_counts(rows, failures, F.col("part"), {"n": n, "good": F.when(F.col("good"), n).otherwise(0), "toxic": F.when(F.col("bad"), n).otherwise(0)})
    return orders(survivors(counts, len(failures), ["n", "good", "toxic"]), "".join(failures), ["good", "toxic"])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and step of the five filters in every source; see audit_documents() for odd rows."""
    return audit_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


# applies each order to each document
ORACLE = rf"""
WITH d AS (SELECT coalesce(doc_id, 9223372036854775807) AS doc, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
y AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN len(ws) < 50 WHEN 'B' THEN 100 * len(list_distinct(ws)) < 65 * len(ws)
    WHEN 'C' THEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE e END) AS fails
  FROM (SELECT *, doc > min(doc) OVER (PARTITION BY text) AS e FROM d) AS d LEFT JOIN y ON y.doc_id = d.doc_id),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c AS a JOIN c AS b ON a.x <> b.x JOIN c ON c.x NOT IN (a.x, b.x) JOIN c AS d ON d.x NOT IN (a.x, b.x, c.x) JOIN c AS e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, filter_order[step] AS x FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f GROUP BY ALL),
q AS (SELECT part, filter_order, step, x, n, good, bad, fails, list_contains(fails, x) AS failing,
    coalesce(list_min(list_transform(fails, lambda c: CAST(strpos(filter_order, c) AS BIGINT))), 99) AS gone FROM g, s),
t AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE gone > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE gone = step), 0) AS removed, coalesce(sum(n) FILTER (WHERE failing AND gone < step), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = [x]), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE gone = step), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE gone = step), 0) AS toxic_lost FROM q GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t
"""
