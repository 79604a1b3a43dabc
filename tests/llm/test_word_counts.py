"""The counts of words of decontamination, against a plain regex."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm import decontaminate as D

TEXTS = [None, "", " ", "a", "A b", "\x00x\x7f", "naïve é-té, 12:3", "　wide", "", None, "one  two\nthree", "😀 x"]
EXPECTED = [len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for t in TEXTS]


def test_word_counts():
    assert D._count_words(pa.array(TEXTS)).to_pylist() == EXPECTED
    assert D._count_words(pa.array(TEXTS)[3:9]).to_pylist() == EXPECTED[3:9] and D._count_words(pa.array([None, ""], pa.string())).to_pylist() == [0, 0]


def test_word_counts_of_rows_need_no_regex(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n", D.ascii_words("text"))
    assert [r.n for r in df.orderBy("doc_id").collect()] == EXPECTED
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
