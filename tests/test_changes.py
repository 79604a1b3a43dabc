"""Diffs, gates and clusters against plain loops."""

import random
import re

from pyspark.sql import functions as F

from textloom.operators import changes as C
from textloom.operators import clusters as X
from textloom.operators import scoring
from textloom.sources import sinks


def plain_diff(diff):
    out, path, line, file = [], None, 0, -1
    for x in diff.split("\n"):
        head = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", x)
        if x.startswith("--- a/"):
            path = None
        elif x.startswith("+++ b/"):
            path, line, file = x[6:], 0, file + 1
        elif x.startswith("@@") and path:
            line = int(head[1]) - 1 if head else line
        elif x.startswith("+") and not x.startswith("+++") and path:
            line += 1
            out.append((file, path, line, x[1:]))
        elif not x.startswith(("-", "\\")) and line > 0:
            line += 1
    return out


def test_diff_lines(spark):
    draw = random.Random(5)
    kinds = ["--- a/f.py", "+++ b/f.py", "+++ b/g.py", "@@ -1,2 +1 @@", "@@ -3 +14,2 @@ x", "@@ odd", "+new", "+other line", "-old", " same", "", "\\ note", "+++ x", "plain"]
    diffs = ["\n".join(draw.choices(kinds, k=draw.randrange(25))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(diffs)), "id long, diff string")
    got = {}
    for r in C.diff_lines(df, ["id"]).collect():
        got.setdefault(r["id"], []).append((r["file"], r["path"], r["line"], r["content"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(plain_diff(d)) for i, d in enumerate(diffs) if d and plain_diff(d)}


def test_gate(spark):
    df = spark.createDataFrame([(1, "code_review", "Updated stuff to fix security issues and things", "", []), (2, "code_review", "short", "+x = 1 # x", ["ok", "nice", "fine"])], "id long, domain string, text string, diff string, comments array<string>")
    rows = {r["id"]: r for r in C.summary(C.gate(scoring.score_documents(df, ["id"], explain=True), least=60)).collect()}
    assert not rows[1]["passed"] and "below minimum 60" in rows[1]["fail_reasons"][0] and "FAIL" in rows[1]["report"]
    assert not rows[2]["passed"]


def test_leaders_follow_the_order(spark):
    draw = random.Random(6)
    pairs = sorted({(b, *sorted(draw.sample(range(30), 2))) for b in range(4) for _ in range(40)} | {(9, i, i + 1) for i in range(12)})
    want = set()
    for batch in {p[0] for p in pairs}:
        used = set()
        for left in range(31):
            group = [b for x, a, b in pairs if x == batch and a == left]
            if left not in used and group:
                used |= {left, *group}
                want |= {(batch, left, b) for b in group}
    got = X.leaders(spark.createDataFrame(pairs, "batch long, a long, b long"))
    assert {tuple(r) for r in got.collect()} == want


def test_equal_texts_of_a_batch_are_a_cluster(spark):
    texts = ["Amazing product. Great quality. Highly recommend.", "Amazing product. Great quality. Highly recommend.", "The battery lasted 9 hours and the screen is bright at 500 nits.", ""]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 7, texts[0])], "batch long, id long, text string")
    assert [(r["batch"], r["leader"], r["items"]) for r in X.batch_clusters(df).collect()] == [(1, 0, [0, 1])]



def test_similar_pairs_of_small_and_large_batches(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    base = [" ".join(draw.choices(words, k=draw.choice([4, 8, 40]))) for _ in range(6)]
    texts = [" ".join(w for w in draw.choice(base).split() if draw.random() > 0.15) for _ in range(40)] + ["", "ab", "Éa 𝒳yz 𝒳yz", "Éa 𝒳yz 𝒳y"]
    df = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "batch long, id long, text string")

    def index(a, b):
        return len(a & b) / len(a | b) if a | b else 0

    sets = [({w for w in re.findall(r"[a-z][a-z0-9_'-]*", t.lower()) if len(w) > 3}, {t.lower()[i : i + 3] for i in range(len(t) - 2)}) for t in texts]
    every = {(a % 2, a, b): (index(sets[a][0], sets[b][0]) + index(sets[a][1], sets[b][1])) / 2 for b in range(len(texts)) for a in range(b) if (b - a) % 2 == 0}
    want = {k: round(v, 6) for k, v in every.items() if v >= 0.45}
    assert len(want) > 20 and any(0.3 < v < 0.45 for v in every.values())
    for most in (64, 1):
        monkeypatch.setattr(X, "DIRECT_TEXTS", most)
        assert {(r[0], r[1], r[2]): round(r[3], 6) for r in X.similar_pairs(df).collect()} == want


def test_elements_of_small_batches_are_not_shuffled(spark):
    text = "a text of this batch, of which no letter triple becomes a row of its own " * 20
    pairs = X.similar_pairs(spark.createDataFrame([(1, i, f"{text}{i}") for i in range(20)], "batch long, id long, text string"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "prefixes" not in plan and "collect_list" not in plan and plan.count("RepartitionByExpression [batch") == 2 and pairs.count() == 190


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i % 3}", float(i)) for i in range(10)], "event_id long, user_id string, score double").withColumn("ts", F.current_timestamp())
    for _ in range(2):
        sinks.record_scores(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 20
    sinks.write_json(df, f"{tmp_path}/j")
    sinks.append_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 20
    sinks.record_feedback(df.withColumn("user_label", F.lit("slop")), f"{tmp_path}/f")
    try:
        sinks.record_feedback(df.withColumn("user_label", F.lit("odd")), f"{tmp_path}/f")
        raise AssertionError
    except ValueError as e:
        assert "10 rows" in str(e)
    log = sinks.log_table(spark, f"file://{tmp_path}/logs", "log string, ts long, event_id long", 4)
    for start in (0, 3):
        log.upsert(spark.range(start, start + 5).select(F.lit("a").alias("log"), F.col("id").alias("ts"), F.col("id").alias("event_id")))
    log.upsert(spark.createDataFrame([("b", 1, 1), (None, 2, 2)], "log string, ts long, event_id long"))
    assert sorted(map(str, log.read().select("log", "ts").collect())) == sorted(map(str, [*(f"Row(log='a', ts={t})" for t in (4, 5, 6, 7)), "Row(log='b', ts=1)", "Row(log=None, ts=2)"]))
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], "user_id string, v int, updated_at int")
    new = spark.createDataFrame([("a", 3, 5), ("b", 4, 4), ("c", 5, 1)], "user_id string, v int, updated_at int")
    assert {tuple(r) for r in sinks.upserted(old, new).collect()} == {("a", 3, 5), ("b", 2, 5), ("c", 5, 1)}
