"""Dataset builders on small tables made for the case."""

from pyspark.sql import functions as F

from textloom.functions.text import html_text
from textloom.operators import datasets as D


def test_filler_phrases_of_two_to_six_words(spark):
    texts = ["we ensure that one two three four"] * 3 + ["only here we leverage it", "a robust solution"] * 2 + ["a robust solution", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = texts[0].split()
    want = {" ".join(words[i : i + n]): 3 for n in range(2, 7) for i in range(len(words) - n + 1) if "ensure" in words[i : i + n]} | {"a robust": 3}
    # phrases with the known "robust solution" and phrases of two documents are out
    assert {r["phrase"]: r["docs"] for r in D.filler_phrases(df, 3).collect()} == {p: n for p, n in want.items() if 8 <= len(p) <= 60}


def test_html_text_is_whole(spark):
    df = spark.createDataFrame([("<p>" + "word " * 2000 + "</p><script>x</script> end",)], "html string")
    assert df.select(html_text(F.col("html"))).first()[0] == "word " * 2000 + "end"
    assert df.select(html_text(F.col("html"), most=3000)).first()[0] == ("word " * 2000)[:3000]


def test_without_passages_looks_at_whole_texts(spark):
    known = " ".join("abcdefghijkl")
    texts = ["x " * 100 + known, "x " * 100 + "b c d e f g h i j k", "x a b c d e f g h i x", None, "", "say hello now", "Hello world again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = D.without_passages(docs, spark.createDataFrame([(known,), (None,), ("",), ("hello world",)], "text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5]


def test_without_known_treats_nulls_as_the_sql_does(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    left = lambda *known: sorted(r["doc_id"] for r in D.without_known(docs, spark.createDataFrame([(k,) for k in known], "text string")).collect())
    assert left("a") == [2] and left("a", None) == [] and left() == [1, 2, 3]
