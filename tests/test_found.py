"""Counts told by RE2 against the Java expressions that they stand for."""

from pyspark.sql import functions as F

from textloom.functions import found as W
from textloom.functions import lexicons as L
from textloom.functions.text import all_matches, any_match, present
from textloom.operators import scoring
from textloom.operators import signals as S
from textloom.operators import stance as ST

TEXTS = [
    "", None, "We saw it; we, us and OUR API_KEY in src/app.py took 420 ms. It is fine: p95 was 12,500. I don't!", "Naïve café: the éus and usé may not always scale, so we found it.", "éus we uś",
    "Trade-off: faster now but\x0bslower then. We\x0bsaw it.", "Kelvin Keep, long ſince we ıt i̇f.", "٣ was 3٤ and we changed it to 4x slower", "然后 we measured 它 because 我们 think so.", "before\n\n12, before 13\x85and after 14",
    "Actually, wait. Edit: v2 was never now. On the one hand it may be slow, on the other hand not.", "ababa the the aea ere eree", "we‍us we‿us 𝔘us we",
]


def _frame(spark):
    rows = [(i, t, d) for i, (t, d) in enumerate((t, d) for t in TEXTS for d in ["docs", "academia", "social_news", "hiring", None])]
    return W.with_found(S.text_features(spark.createDataFrame(rows, "id long, text string, domain string"), ["id"]))


def test_counts_equal_java(spark):
    df, low, text = _frame(spark), F.col("_low"), F.col("text")
    java = {k: present(low, p) for k, p in W.PHRASES.items()} | {k: ST.hits(low, p) for k, p in W.ONCE.items() if k not in ("conditional", "comparative", "tradeoff")}
    java |= {k: sum((text.rlike("(?iUd)" + p).cast("int") for p in W.ONCE[k]), F.lit(0)) for k in ("conditional", "comparative", "tradeoff")}
    java |= {k: F.regexp_count(text, F.lit("(?iUd)" + W.TIMES[k])) for k in ("personal", "distant")} | {k: F.regexp_count(low, F.lit("(?Ud)" + W.TIMES[k])) for k in ("before", "reduced", "contraction")}
    java |= {f"concrete{i}": all_matches(text, [p]) for i, p in enumerate(L.CONCRETE)}
    wrong = [F.when(F.get("_found", F.lit(W.PLACE[k])) != j, k) for k, j in java.items()]
    assert df.select("text", F.array_compact(F.array(*wrong)).alias("wrong")).filter(F.size("wrong") > 0).collect() == []
    for d in ("docs", "academia", "social_news", "hiring"):
        own = [F.when(F.get("_found", F.lit(W.PLACE[f"own{i}"])) != F.regexp_count(text, F.lit(("(?Ud)" if n in W.CASED else "(?iUd)") + p)), n) for i, (n, p) in enumerate(W.COUNTS[d].items())]
        assert df.filter(F.col("domain") == d).select("text", F.array_compact(F.array(*own)).alias("wrong")).filter(F.size("wrong") > 0).collect() == []


def test_flags_equal_java(spark):
    rows = _frame(spark).select(F.explode(F.arrays_zip("sents", "_flags")).alias("x")).select(F.col("x.sents").alias("s"), F.col("x._flags").alias("f")).filter("f is not null")
    assert rows.count() > 0
    assert rows.filter((F.col("f").bitwiseAND(F.lit(W.CONCRETE)) != 0) != any_match(F.col("s"), L.CONCRETE)).count() == 0
    assert rows.filter((F.col("f").bitwiseAND(F.lit(W.EVIDENCE)) != 0) != any_match(F.col("s"), L.EVIDENCE)).count() == 0
    assert rows.filter((F.col("f").bitwiseAND(F.lit(W.CAUSAL)) != 0) != F.col("s").rlike("(?iUd)" + W.R.CAUSAL)).count() == 0


def test_score_counts_in_arrow(spark):
    docs = spark.createDataFrame([(1, TEXTS[2], "docs")], "id long, text string, domain string")
    plan = scoring.score_documents(docs, ["id", "domain"])._jdf.queryExecution().optimizedPlan().toString()
    assert "found(" in plan and "flags(" in plan


def test_features_are_those_that_are_read(spark):
    docs = spark.createDataFrame([(1, TEXTS[2])], "id long, text string")
    df = S.text_features(docs, ["id"], ("sents",))
    assert df.columns == ["id", "text", "sents"]
    assert "a-z0-9_" not in df._jdf.queryExecution().optimizedPlan().toString()  # no words are looked for
    only = W.with_found(S.text_features(docs, ["id"]), names=("personal",), sentences=False).select(F.get("_found", F.lit(W.PLACE["personal"])).alias("n"), F.get("_found", F.lit(0)).alias("none"))
    assert [tuple(r) for r in only.collect()] == [(5, None)]
