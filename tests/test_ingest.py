"""Stored state and continuous jobs: each ends with what its batch form gives, also after a crash."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators import analytics
from textloom.sources.keyed_table import KeyedTable, newest, summed
from textloom.streaming import ingest as I

NOON = datetime(2024, 5, 1, 12)
WORDS = "we ensure that overall the robust plan will leverage many things in today and effectively never moving forward 7 x".split()


@pytest.fixture()
def rocks(spark):
    spark.conf.set(*I.ROCKSDB)
    yield
    spark.conf.unset(I.ROCKSDB[0])


class Crash(Exception):
    pass


def crash():
    raise Crash


# ---- keyed table -------------------------------------------------------------------------------------------------------


def test_keyed_table_takes_the_newest_row(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id long, v string, at long", ["id"], newest(["id"], "at"), buckets=8)
    assert t.read().collect() == []
    t.upsert(spark.createDataFrame([(i, "a", 5) for i in range(40)] + [(None, "n", 1)], "id long, v string, at long"))
    before = t.manifest()["folders"]
    t.upsert(spark.createDataFrame([(3, "old", 4), (3, "older", 1), (7, "new", 5), (7, "new", 5), (None, "m", 2)], "id long, v string, at long"))
    want = {i: ("a", 5) for i in range(40)} | {7: ("new", 5), None: ("m", 2)}
    assert {r["id"]: (r["v"], r["at"]) for r in t.read().collect()} == want and t.read().count() == 41
    after = t.manifest()["folders"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 3  # only the buckets of 3, 7 and null
    assert [tuple(r) for r in t.lookup(spark.createDataFrame([(7,), (99,)], "id long")).collect()] == [(7, "new", 5)]


def test_keyed_table_crash_before_the_swap(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id long, n long", ["id"], summed(["id"], ["n"]), buckets=4)
    one = spark.createDataFrame([(i % 10, 1) for i in range(100)], "id long, n long")
    assert t.upsert(one, "w", 0)
    with pytest.raises(Crash):
        t.upsert(one, "w", 1, before_swap=crash)
    assert {tuple(r) for r in t.read().collect()} == {(i, 10) for i in range(10)} and t.manifest()["version"] == 1
    assert t.upsert(one, "w", 1) and not t.upsert(one, "w", 1) and not t.upsert(one, "w", 0)
    assert {tuple(r) for r in t.read().collect()} == {(i, 20) for i in range(10)}
    assert t.upsert(one.limit(0), "w", 2) and t.applied("w", 2) and not t.applied("other", 0)
    assert len(t.clean()) == 2  # the first version and what the crash left
    assert {tuple(r) for r in t.read().collect()} == {(i, 20) for i in range(10)}
    with pytest.raises(RuntimeError):  # another writer was there first
        t.upsert(one, before_swap=lambda: KeyedTable(spark, t.path, t.schema, ["id"], t.combine, 4).upsert(one))
    assert t.read().agg(F.sum("n")).first()[0] == 300


# ---- score and store ---------------------------------------------------------------------------------------------------


def texts(n):
    out = []
    for i in range(n):
        words = [WORDS[(i * 7 + j * (1 + i % 5)) % len(WORDS)] for j in range(4 + i % 9)]
        text = None if i == 5 else "" if i == 6 else "  short \n" if i == 7 else " ".join(words) + " and some more of it"
        out.append((i, NOON + timedelta(seconds=(i * 37) % 900), ["docs", "content", None][i % 3], ["a", "b", "", None][i % 4], f"title {i} " * 30, text, float(i % 90)))
    return out


SCHEMA = "doc_id long, ts timestamp, domain string, source string, title string, text string, score double"


def scored(docs):
    return docs.withColumn("oversight", F.when(F.col("score") < 47, "low").otherwise("high"))


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing"))
    spark.createDataFrame(texts(120), SCHEMA).repartition(4).write.mode("overwrite").parquet(path)
    return path


def stream(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("step", ["feed", "counters"])
def test_score_and_store_after_crashes(spark, landing, tmp_path, step):
    path, told = f"file://{tmp_path}/store", []

    def fails_once(done):
        told.append(done)
        if told.count(step) in (1, 3) and done == step:
            crash()

    for _ in range(4):  # each run goes on where the last one died
        try:
            I.score_and_store(stream(spark, landing), scored, path, str(tmp_path / "c"), fails_once).awaitTermination()
            break
        except Exception as e:  # noqa: BLE001 - the query wraps it
            assert "Crash" in str(e)
    assert told.count("feed") == (6 if step == "feed" else 4) and told.count("counters") == 4  # two of four batches once more, if they were not counted yet
    docs = spark.read.schema(SCHEMA).parquet(landing)
    want = I.feed_rows(docs, scored)
    got = I.read_feed(spark, path).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 117
    counted = {(r["kind"], r["key"]): (r["n"], r["last"]) for r in I.counter_table(spark, f"{path}/counters").read().collect()}
    assert counted == {(r["kind"], r["key"]): (r["n"], r["last"]) for r in I.counters(docs, want).collect()}
    assert counted["ingested", ""][0] == 120 and counted["scored", ""][0] == 117 and sum(n for (k, _), (n, _) in counted.items() if k == "source") == 117


# ---- phrases -----------------------------------------------------------------------------------------------------------


def slow_candidates(text):
    words, out = (text or "").lower().split(), []
    for n in range(2, 7):
        for i in range(len(words) - n + 1):
            p = " ".join(words[i : i + n])
            if 8 <= len(p) <= 60 and not any(c.isdigit() for c in p) and any(f in p for f in I.L.FILLER):
                out.append(p)
    return out[:5]


def test_candidates_in_order(spark, landing):
    docs = spark.read.parquet(landing)
    rows = docs.select("doc_id", "text", F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0)).alias("words"))
    for r in rows.select("text", I.candidate_phrases(F.col("text"), F.col("words")).alias("p")).collect():
        assert (r["p"] or []) == slow_candidates(r["text"])


def queue_of(states, **options):
    return {r["phrase"]: tuple(r)[1:] for r in I.listing(states, **options).collect()}


def test_pattern_stream_equals_batch(spark, rocks, landing, tmp_path):
    docs = spark.read.schema(SCHEMA).parquet(landing)
    found = sorted({r["phrase"] for r in I.candidates(docs).collect()})
    asked = [(found[0], NOON + timedelta(days=1)), (found[1], NOON - timedelta(days=1)), ("never seen", NOON + timedelta(days=1))]
    spark.createDataFrame(asked, "phrase string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "asks"))
    path = f"file://{tmp_path}/patterns"
    I.pattern_stream(stream(spark, landing), stream(spark, str(tmp_path / "asks"), "phrase string, ts timestamp"), path, str(tmp_path / "c")).awaitTermination()
    batch = I.pattern_states(docs, spark.createDataFrame(asked, "phrase string, ts timestamp"))
    got, want = queue_of(I.pattern_table(spark, path).read()), queue_of(batch)
    assert got == want and len(want) == len(found) > 20
    assert [p for p, r in want.items() if r[-1]] == [found[0]] and all(len(r[3]) == min(3, r[0]) for r in want.values())
    assert queue_of(batch, ready_only=True) == {p: r for p, r in want.items() if r[0] >= 3}


def test_phrases_expire(spark, rocks, tmp_path):
    path = str(tmp_path / "in")
    for k, minute in enumerate((0, 50, 200)):
        text = "we ensure it" if k < 2 else "a robust one"
        spark.createDataFrame([(k, NOON + timedelta(minutes=minute), "docs", "a", "t", text, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    # one more batch, so that the watermark of the one before takes effect
    I.pattern_stream(stream(spark, path), spark.readStream.schema("phrase string, ts timestamp").parquet(str(tmp_path / "in2")) if (tmp_path / "in2").mkdir() is None else None, f"file://{tmp_path}/p", str(tmp_path / "c"), "1 minute", expire=3600).awaitTermination()
    assert queue_of(I.pattern_table(spark, f"file://{tmp_path}/p").read()).keys() == {"a robust", "robust one", "a robust one"}


# ---- thresholds and ticker ---------------------------------------------------------------------------------------------


def test_threshold_stream_equals_batch(spark, rocks, tmp_path):
    rows = [(d, NOON + timedelta(seconds=(i * 53) % 600), i, (i * i) % 3 == 0, (i % 7) / 6) for i in range(150) for d in ("docs", "content") if i % 2 or d == "docs"]
    kind = "domain string, ts timestamp, id long, was_too_harsh boolean, confidence double"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, kind).repartition(3, "id").write.parquet(path)  # in no order of time
    spark.createDataFrame([("closing", NOON + timedelta(hours=2), 0, True, 0.0)], kind).coalesce(1).write.mode("append").parquet(path)
    out = I.threshold_stream(stream(spark, path, kind), late="15 minutes")
    seen = []
    out.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for domain, threshold, folded, waiting in seen:
        if folded >= got.get(domain, (0, 0))[1]:
            got[domain] = (threshold, folded, waiting)
    batch = {r["domain"]: r["threshold"] for r in analytics.adapt_thresholds(spark.createDataFrame(rows, kind)).collect()}
    assert {d: t for d, (t, _, _) in got.items()} == batch and got["docs"][1:] == (150, 0) and got["content"][1:] == (75, 0)


def ticks(n):
    return [(NOON + timedelta(seconds=(i * 17) % 400), ["x", "y", None][i % 3], ["r", "s", None, "q"][(i * i) % 4], float((i * 31) % 100), i % 4 == 0) for i in range(n)]


def test_ticker_stream_equals_batch(spark, tmp_path):
    kind = "ts timestamp, domain string, repo_id string, score double, is_slop boolean"
    path = str(tmp_path / "in")
    spark.createDataFrame(ticks(80), kind).repartition(3).write.parquet(path)
    spark.createDataFrame([(NOON + timedelta(hours=3), "x", "r", 1.0, False)], kind).coalesce(1).write.mode("append").parquet(path)
    seen = []
    out = I.ticker_windows(stream(spark, path, kind), late="10 minutes")
    out.writeStream.outputMode("append").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    closed = [tuple(r) for r in I.ticker_windows(spark.read.schema(kind).parquet(path)).collect() if r["until"] < NOON + timedelta(hours=1)]
    assert sorted(map(str, seen)) == sorted(map(str, closed)) and len(closed) > 10
    for until, total, slop, _, mean, before, *_ in closed:
        own = [t for t in ticks(80) if until - timedelta(seconds=60) <= t[0] < until]
        past = [t[3] for t in ticks(80) if until - timedelta(seconds=120) <= t[0] < until - timedelta(seconds=60)]
        assert total == len(own) and slop == sum(t[4] for t in own) and abs(mean - sum(t[3] for t in own) / total) < 0.06
        assert (before is None) == (not past) and (not past or abs(before - sum(past) / len(past)) < 0.06)
    assert I.ticker_windows(spark.createDataFrame([], kind)).collect() == []  # warming up
