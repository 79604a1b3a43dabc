"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written


def components(edges: DataFrame, *, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(node, component): component is the smallest node reachable; edges: two columns of one type, no nulls.

    Each round links every neighbour of a node to the smallest one (large star, then small star), which
    halves the depth; a node with many edges is pre-aggregated before each shuffle. Ends when nothing changes.
    """
    a, b = names
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = written(pairs, "edges")
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        new = written(small, "edges")
        # done when every node points at one root, and no root points on
        multiple = new.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        chained = new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        pairs = new
        if multiple.unionAll(chained).isEmpty():
            break
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
