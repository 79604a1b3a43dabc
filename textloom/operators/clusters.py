"""Clusters of similar texts of a batch: similar pairs, then leaders in the order of the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import settled, tokens
from textloom.sources.scratch import written


#: Texts of a batch that are compared pair by pair, as in a batch of a feed; larger batches go by the inverted index.
DIRECT_TEXTS = 64


def _packed(docs: DataFrame) -> DataFrame:
    """(batch, id, words, triples, n_words, n_triples): both sets as one string each, as an array of short strings takes 16 bytes an element and more."""
    low = F.lower("text")
    # all triples are those of three tilings of the text
    tiled = lambda k: F.regexp_extract_all(F.substring(low, k, 2_000_000_000), F.lit("(?s).{3}"), F.lit(0))
    words = F.array_distinct(F.filter(tokens(F.col("text")), lambda w: F.char_length(w) > 3))
    sets = settled(docs.select("batch", "id", words.alias("words"), F.array_distinct(F.concat(*map(tiled, (1, 2, 3)))).alias("triples")))
    return sets.select("batch", "id", F.array_join("words", " ").alias("words"), F.array_join("triples", "").alias("triples"), F.size("words").alias("n_words"), F.size("triples").alias("n_triples"))


def _elements(packed: str, kind: str) -> Column:
    return F.filter(F.split(packed, " "), lambda w: w != "") if kind == "words" else F.regexp_extract_all(packed, F.lit("(?s).{3}"), F.lit(0))


def _shared(kind: str) -> Column:
    """The Jaccard index of both sides of a pair; 0 where the union is empty."""
    both = F.size(F.array_intersect(_elements(f"a_{kind}", kind), _elements(f"b_{kind}", kind)))
    union = F.col(f"a_n_{kind}") + F.col(f"b_n_{kind}") - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def _most(kind: str) -> Column:
    """What the index can be at most, by sizes alone."""
    a, b = F.col(f"a_n_{kind}"), F.col(f"b_n_{kind}")
    return F.when(F.greatest(a, b) == 0, 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def _side(sets: DataFrame, side: str) -> DataFrame:
    return sets.select("batch", F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("words", "triples", "n_words", "n_triples")))


def _similar(pairs: DataFrame, least: float) -> DataFrame:
    """(batch, a, b, similarity) of the pairs that reach it: half the Jaccard index of words over three letters and half that of letter triples."""
    nearly = least - 1e-9
    kept = pairs.filter(_most("words") + _most("triples") >= 2 * nearly).filter(_shared("words") + _most("triples") >= 2 * nearly)
    return settled(kept.select("batch", "a", "b", (_shared("words") * 0.5 + _shared("triples") * 0.5).alias("similarity"))).filter(F.col("similarity") >= least)


def similar_pairs(docs: DataFrame, least: float = 0.45) -> DataFrame:
    """(batch, a, b, similarity) of texts (batch, id, text) of a batch, a < b, with similarity >= least.

    In batches of up to DIRECT_TEXTS texts each meets each where the batch is, so a text is shuffled once and its elements never; sizes rule most
    pairs out. Larger batches, if any, find their candidates by an inverted index. Both test each candidate on the whole sets.
    """
    large = written(docs.groupBy("batch").count().filter(F.col("count") > DIRECT_TEXTS).select("batch"), "large")
    if large.isEmpty():
        return _direct_pairs(docs, least)
    return _direct_pairs(docs.join(large, "batch", "left_anti"), least).unionByName(_indexed_pairs(docs.join(large, "batch", "left_semi"), least))


def _direct_pairs(docs: DataFrame, least: float) -> DataFrame:
    sets = _packed(docs).repartition("batch")
    return _similar(_side(sets, "a").join(_side(sets, "b"), "batch").filter("a < b"), least)


def _indexed_pairs(docs: DataFrame, least: float) -> DataFrame:
    """Of the two indexes one is `least` at least. Two sets whose index is t share one of the first n - ceil(t n) + 1 elements of either in any
    common order; the order is by how rare an element is, so common ones make no candidates.
    """
    sets = written(_packed(docs), "sets")
    either = [sets.select("batch", "id", F.lit(k).alias("kind"), F.col(f"n_{c}").alias("n"), F.explode(_elements(c, c)).alias("x")) for k, c in enumerate(("words", "triples"))]
    elements = either[0].unionByName(either[1])
    often = elements.groupBy("kind", "x").agg(F.count("*").alias("often"))
    ranked = elements.join(often, ["kind", "x"]).groupBy("batch", "id", "kind").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "x"))).alias("xs"))
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    prefix = written(ranked.select("batch", "id", "kind", F.explode(F.slice("xs", 1, first.cast("int"))).alias("e")).select("batch", "id", "kind", "e.x"), "prefixes")
    a, b = (prefix.select("batch", "kind", "x", F.col("id").alias(c)) for c in "ab")
    pairs = written(a.join(b, ["batch", "kind", "x"]).filter("a < b").select("batch", "a", "b").distinct(), "pairs")
    for c in "ab":
        pairs = pairs.join(_side(sets, c), ["batch", c])
    return _similar(pairs, least)


#: Open pairs that are settled in one grouped call; with more, a round of joins settles a part first.
SETTLE_PAIRS = 200_000


def _settle(pairs):
    """The leaders among the items of a batch, one after another."""
    import pandas as pd

    smaller: dict = {}
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
        smaller.setdefault(a, [])
        smaller.setdefault(b, []).append(a)
    leads: dict = {}
    for i in sorted(smaller):
        leads[i] = not any(leads[x] for x in smaller[i])
    return pd.DataFrame({"batch": pairs["batch"].iloc[0], "id": pd.Series([i for i, x in leads.items() if x], dtype=pairs["a"].dtype)})


def leaders(pairs: DataFrame) -> DataFrame:
    """(batch, leader, member) of pairs (batch, a, b), a < b: an item is a leader unless a smaller leader is linked with it; a leader's members are all its larger partners.

    Groups may share members; a leader without larger partners has no row.
    """
    pairs = written(pairs.select("batch", "a", "b").distinct(), "pairs")
    return pairs.join(leading(pairs).withColumnRenamed("id", "a"), ["batch", "a"], "left_semi").select("batch", F.col("a").alias("leader"), F.col("b").alias("member"))


def leading(pairs: DataFrame) -> DataFrame:
    """(batch, id) of the leaders among the items of pairs (batch, a, b), a < b, also of those without larger partners; reads pairs several times, so give it a written table.

    In a round, items without a smaller open partner lead and settle their partners; what is left open is settled in
    one call a batch as soon as it is SETTLE_PAIRS pairs or fewer.
    """
    ends = lambda p: p.select("batch", F.col("a").alias("id")).unionAll(p.select("batch", F.col("b").alias("id"))).distinct()
    left, lead = pairs, None
    while left.count() > SETTLE_PAIRS:
        heads = left.select("batch", F.col("a").alias("id")).distinct().join(left.select("batch", F.col("b").alias("id")), ["batch", "id"], "left_anti")
        heads = written(heads, "heads")
        led = left.join(heads.withColumnRenamed("id", "a"), ["batch", "a"], "left_semi").select("batch", F.col("b").alias("id")).distinct()
        settled_ = written(heads.unionAll(led), "settled")
        rest = left
        for c in "ab":
            rest = rest.join(settled_.withColumnRenamed("id", c), ["batch", c], "left_anti")
        rest = written(rest.select("batch", "a", "b"), "open")
        # items that are neither settled nor linked with an open one have no leader before them
        alone = ends(left).join(settled_, ["batch", "id"], "left_anti").join(ends(rest), ["batch", "id"], "left_anti")
        part = heads.unionAll(alone)
        lead = part if lead is None else lead.unionAll(part)
        left = rest
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    last = left.groupBy("batch").applyInPandas(_settle, f"batch {kinds['batch']}, id {kinds['a']}")
    return written(last if lead is None else lead.unionAll(last), "leaders")


def batch_clusters(docs: DataFrame, least: float = 0.45) -> DataFrame:
    """(batch, leader, items, size): clusters of texts (batch, id, text) of a batch that are similar to their leader, the smallest id."""
    found = leaders(similar_pairs(docs, least))
    items = F.sort_array(F.collect_set("member"))
    return found.groupBy("batch", "leader").agg(items.alias("items")).select("batch", "leader", F.concat(F.array("leader"), "items").alias("items"), (F.size("items") + 1).alias("size"))
