"""Analytics over ranges of rows against the plain fold."""

import random

from pyspark.sql import functions as F

from textloom.operators import analytics as A


def test_thresholds_fold_by_ranges(spark):
    draw = random.Random(3)
    rows = [(draw.choice("aaaab"), draw.randrange(500), i, draw.random() < 0.5, draw.randrange(0, 21) / 10) for i in range(3000)] + [("up", 1, i, False, 1.0) for i in range(400)]
    want = {}
    for d, _, _, harsh, sure in sorted(rows):
        want[d] = max(3000, min(7000, want.get(d, 4800) + (-1 if harsh else 1) * round(min(2, 2 * sure) * 5)))
    df = spark.createDataFrame(rows, "domain string, ts long, id long, was_too_harsh boolean, confidence double").repartition(5)
    out = A.adapt_thresholds(df)
    assert {r["domain"]: r["threshold"] for r in out.collect()} == {d: x / 100 for d, x in want.items()}
    # no array of a domain's rows: the only lists are of ranges
    assert "MapInArrow" in out._jdf.queryExecution().toString()


def test_stats_with_null_keys_and_a_hot_one(spark):
    rows = [(i, "d" if i % 3 else None, "r" if i % 2 else None, str(i % 3), float(i % 100)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, domain string, repo_id string, author_id string, score double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
    got = {(r["kind"], r["key"]): (r["n"], r["slop_count"], r["items_per_minute"]) for r in A.ingestion_stats(df, 48).collect()}
    assert got == {("total", ""): (300, 144, 1.0), ("domain", "d"): (200, 96, None), ("domain", None): (100, 48, None), ("repo_id", "r"): (150, 72, None), ("repo_id", None): (150, 72, None)}
    assert A.ingestion_stats(df.limit(0), 48).collect() == []
    one = A.user_summaries(df.withColumn("author_id", F.lit("a")), 50).collect()
    assert len(one) == 1 and one[0]["total_scored"] == 50 and one[0]["average_score"] == round(sum(i % 100 for i in range(250, 300)) / 50, 1)


def test_spread_runs_nothing(spark):
    from textloom.functions.text import spread

    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    spark.sparkContext.setJobGroup("spread", "nothing may run")
    out = spread(counted)
    ran = list(spark.sparkContext.statusTracker().getJobIdsForGroup("spread"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ran == [] and out.count() == 7
