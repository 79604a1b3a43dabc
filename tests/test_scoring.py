"""Shapes of results that texts of a kind must have."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.reasoning_patterns import THRESHOLDS
from textloom.operators import reasoning as R
from textloom.operators import scoring
from textloom.operators import signals as S
from textloom.operators.improve import improve

SCHEMA = "id long, domain string, text string"


def scored(spark, *pairs):
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(pairs)], SCHEMA)
    return [r.asDict(recursive=True) for r in scoring.score_documents(df, ["id", "domain"], explain=True).orderBy("id").collect()]


VAGUE = "Updated authentication flow to fix security issues"
EXACT = "Fixed JWT secret exposure in auth/middleware.js — the old handler logged the full token on line 47, which showed up in CloudWatch. Rotated all secrets, added log sanitization, updated tests."


def test_specific_texts_score_higher(spark):
    rows = scored(
        spark, ("code_review", VAGUE), ("code_review", EXACT),
        ("marketplace", "Amazing product. Great quality. Highly recommend it to everyone."),
        ("marketplace", "The 5000 mAh battery lasted 9 hours, but the USB-C port got warm after the third charge."),
        ("hiring", "I am excited to apply for this role at your company. My passion and dedication make me a great fit."),
        ("hiring", "At PayFlow I reduced failed invoice retries by 22% by adding queue backoff. Your billing role maps to that work."),
    )
    assert all(a["score"] < b["score"] for a, b in zip(rows[::2], rows[1::2]))
    assert rows[0]["oversight"] == "low" and len(rows[1]["strong_claims"]) >= 1
    assert all(r["summary"] == scoring.SUMMARIES[r["oversight"]] and 0 < len(r["signals"]) for r in rows)
    assert all(len(r["reasons"]) <= 4 and len(r["highlights"]) <= 3 for r in rows)
    assert all(r["top_signal"] == min(r["signals"], key=lambda s: s["score"])["name"] for r in rows)


def test_empty_and_short_texts_have_no_signals(spark):
    for r in scored(spark, ("general", ""), ("general", None), ("docs", "Hello"), ("docs", " \n "), ("general", "Looks good.")):
        assert (r["score"], r["oversight"], r["signals"], r["highlights"]) == (0.0, "insufficient", [], [])


def test_every_domain_has_its_signals(spark):
    text = "This is a test text with enough content to make signals across different domains, and some more words."
    rows = scored(spark, *((d, text) for d in [*THRESHOLDS, None, "unknown"]))
    count = {r["domain"]: len(r["signals"]) for r in rows}
    assert count == {"code_review": 14, "docs": 14, "hiring": 13, "communications": 14, "content": 14, "academia": 14, "marketplace": 14, "social_news": 14, "general": 10, None: 10, "unknown": 10}
    assert all(s["label"] for r in rows for s in r["signals"])


def test_long_and_foreign_texts(spark):
    long = "This is a detailed analysis of the login system. It uses JWT tokens with RS256 signing. We measured P95=45ms. " * 100
    for r in scored(spark, ("content", "This sentence is about testing long content. " * 500), ("code_review", long), ("general", "この更新はシステムを改善し、体験を向上させます。堅牢な解決策を提供します。 二つ 三つ")):
        assert 0 <= r["score"] <= 100 and r["oversight"] in scoring.SUMMARIES


def test_filters_on_results_keep_the_plan_small(spark):
    df = spark.createDataFrame([(1, "docs", EXACT), (2, "docs", VAGUE)], SCHEMA)
    out = scoring.score_documents(df, ["id", "domain"]).filter("score > 1 AND oversight != 'x'")
    assert out.count() == 2


@pytest.mark.parametrize(("reason", "low", "high"), [
    ("profiling showed auth middleware adding 340ms to every request", 0.6, 1.0), ("it was slow", 0.0, 0.3), ("significantly faster than the previous approach", 0.3, 0.7),
    ("changed auth/middleware.js to fix the timeout issue", 0.5, 1.0), ("fixed TypeError: cannot read property of undefined on line 47", 0.5, 1.0),
    ("bundle analysis showed moment adding 67kb to the main chunk", 0.5, 1.0), ("slow", 0.15, 0.15),
])
def test_specificity_of_reasons(spark, reason, low, high):
    value = spark.createDataFrame([(reason,)], "r string").select(R.specificity_of(F.col("r"), F.lit(0.0))).first()[0]
    assert low <= value <= high


def test_blended_confidence(spark):
    rows = spark.createDataFrame([(0.9, 0.0, "general"), (0.9, 1.0, "general"), (0.9, 0.0, "docs"), (1.0, 0.5, None)], "c double, s double, d string")
    assert [round(r[0], 4) for r in rows.select(R.blended(F.col("c"), F.col("s"), F.col("d"))).collect()] == [0.36, 0.9, 0.45, 0.7]


def test_claims_are_flagged_or_strong(spark):
    texts = ["Updated the code because it was slow and messy.", "We capped retries at 3 because profiling showed duplicate charges of 200 users in billing/retry.py.", "No reason here.", "", "Long — because\tx"]
    df = spark.createDataFrame([(i, "code_review", t) for i, t in enumerate(texts)], SCHEMA)
    rows = R.claims(S.text_features(df, ["id"]), ["id"]).orderBy("id", "pos").collect()
    assert [(r["id"], r["flagged"]) for r in rows][:2] == [(0, True), (1, False)] and {r["id"] for r in rows} == {0, 1, 4}
    assert rows[0]["action"] == "Updated the code" and rows[0]["reasoning"] == "it was slow and messy."


def test_hints_ask_for_specifics(spark):
    df = spark.createDataFrame([(1, "code_review", "I updated the function because it was slow and needed improvement."), (2, "docs", ""), (3, None, "Improved performance. In 3 runs it took 5 ms.")], SCHEMA)
    rows = {r["id"]: r.asDict(recursive=True) for r in improve(S.text_features(df, ["id"]), ["id"]).collect()}
    assert rows[1]["flagged_sentences"] == 1 and rows[1]["improvement_priority"] == "high" and "?" in rows[1]["suggestions"][0]["questions"][0]
    assert (rows[2]["total_sentences"], rows[2]["flagged_sentences"], rows[2]["improvement_priority"]) == (0, 0, "low")
    assert rows[3]["flagged_sentences"] == 0


def test_novelty_counts_first_uses(spark):
    text = "Alpha beta gamma. Alpha beta delta delta. Nothing new? Alpha gamma alpha."
    df = spark.createDataFrame([(1, "docs", text), (2, "docs", ""), (3, "docs", "...")], SCHEMA)
    rows = {r["id"]: r["curve"] for r in S.with_curve(S.text_features(df, ["id"])).select("id", "curve").collect()}
    assert rows[1] == [1.0, 0.5, 1.0, 0.0] and rows[2] == [] and rows[3] == [0.0]
