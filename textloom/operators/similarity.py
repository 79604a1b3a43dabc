"""Structural clusters and the distance to a mean vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import dot, sentences, tokens


def fingerprint_key(text: Column) -> Column:
    """The lengths in tokens (up to 20) of the first 8 sentences, comma-joined."""
    lengths = F.transform(F.slice(sentences(text), 1, 8), lambda s: F.least(F.lit(20), F.size(tokens(s))))
    return F.array_join(F.transform(lengths, lambda n: n.cast("string")), ",")


def opening_key(text: Column) -> Column:
    """The first five tokens."""
    return F.array_join(F.slice(tokens(text), 1, 5), " ")


def fingerprint_clusters(docs: DataFrame) -> DataFrame:
    """(fingerprint, n, first_id): groups of two or more documents with equal sentence lengths (up to 20) in their first 8 sentences."""
    return _groups(docs.select("doc_id", fingerprint_key(F.col("text")).alias("key")), "fingerprint")


def opening_clusters(docs: DataFrame) -> DataFrame:
    """(opening, n, first_id): groups of documents with the same first five tokens."""
    return _groups(docs.select("doc_id", opening_key(F.col("text")).alias("key")).filter("key != ''"), "opening")


def _groups(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("key").alias(name)).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def centroid_uniqueness(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """(vec_id, uniqueness): 1 - cosine to the mean of the seed vectors, from 0 to 1."""
    mean = seeds.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    df = vectors.join(F.broadcast(mean))  # one row
    return df.select("vec_id", (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot(F.col("embedding"), F.col("c")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("c"), F.col("c"))))) * 1e5 + 0.5) / 1e5).alias("uniqueness"))
