import pytest

from textloom.operators import analytics
from textloom.sources.readers import labelled_json, score_events, text_files
from textloom.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def landing(spark, tmp_path):
    path = str(tmp_path / "events")
    score_events(spark, SF).repartition(3).write.parquet(path)
    return path


def test_running_baselines_equal_batch(spark, landing, tmp_path):
    stream = jobs.read_landing(spark, landing, score_events(spark, SF).schema, 1)
    jobs.run_available(jobs.running_baselines(stream), "state", str(tmp_path / "c"), "update")
    got = {r["domain"]: (r["n"], round(r["mean"], 6), round(r["std"], 6)) for r in spark.sql("SELECT * FROM state ORDER BY n").collect()}
    want = {r["domain"]: (r["n"], round(r["mean"], 6), round(r["std"], 6)) for r in analytics.baselines(score_events(spark, SF)).filter("grain = 'global'").collect()}
    assert got == want


def test_window_scores_are_final(spark, landing, tmp_path):
    stream = jobs.read_landing(spark, landing, score_events(spark, SF).schema)
    rows = jobs.run_available(jobs.window_scores(stream, "1 day"), "windows", str(tmp_path / "c")).collect()
    batch = {(r["bucket"], r["domain"]): r["n"] for r in jobs.window_scores(spark.read.parquet(landing), "1 day").collect()}
    assert rows and all(batch[r["bucket"], r["domain"]] == r["n"] for r in rows)


def test_unique_drops_repeats(spark, tmp_path):
    path = str(tmp_path / "twice")
    e = score_events(spark, SF).limit(50)
    e.unionAll(e).coalesce(1).write.parquet(path)
    stream = jobs.read_landing(spark, path, e.schema)
    assert jobs.run_available(jobs.unique(stream), "unique", str(tmp_path / "c")).count() == 50


def test_labelled_json_and_files(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"label": "Slop", "text": "x", "domain": "docs"}, {"human_or_chatgpt": "human", "sentence": "y"}, {"label": "slop"}]')
    assert sorted(map(tuple, labelled_json(spark, str(p)).collect())) == [("reviewed", "general", "y"), ("slop", "docs", "x")]
    assert text_files(spark, str(p)).count() == 1
