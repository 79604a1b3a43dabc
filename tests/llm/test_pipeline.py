"""The pipeline's contract: its stages keep the columns, carry out their decisions, and pack what is left."""

import threading

import corpus_pipeline as P
from textloom.llm.decontaminate import decontaminate
from textloom.llm.jaccard_join import jaccard_join


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = P.written(stage(spark, docs, sf), name)
        assert out.columns == P.COLUMNS
        assert out.join(docs, "doc_id", "left_anti").isEmpty() and 0 < out.count() <= docs.count()
        if name == "near_dedup":
            again = jaccard_join(out, width=5, percent=80)
            assert again.filter("n_shingles > 0 AND component_id != doc_id").isEmpty()
        if name == "benchmark_decontamination":
            assert decontaminate(out, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").isEmpty()
        docs = out
    pieces = P.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, equal texts and no rows at all pass through every stage."""
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (900001, " \t\n", None, None, 3), (900002, "word " * 20_000, "en", "s", 100_000)], base.schema)
    docs = base.unionByName(odd).unionByName(base.limit(5))
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in P.STAGES[:-1]:
            now = P.written(stage(spark, now, sf), name)
            assert now.columns == P.COLUMNS and now.count() <= rows.count()
        assert P.STAGES[-1][1](spark, now, sf).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_a_run_deletes_its_own_tables_only(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    mine = P.written(docs, "elsewhere")
    first = P.written(P.STAGES[0][1](spark, docs, sf), "one")
    lazy = P.STAGES[1][1](spark, first, sf)
    made = P._MADE[threading.get_ident(), sf]
    paths = list(made.paths)
    other = P.STAGES[1][1](spark, first, f"{sf}/")  # another run, over another name of the folder
    assert paths and lazy.count() == other.count()
    second = P.written(lazy, "two")
    P.STAGES[2][1](spark, second, sf)
    assert made.paths == [] and other.count() == second.count() and mine.count() == 60
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_stages_leave_out_other_columns(spark):
    """Columns beside those of documents, also under names that operators give to theirs, are dropped and change nothing."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    more = docs.selectExpr("*", "'x' AS score", "1 AS n_words", "'y' AS component_id", "2 AS contaminated", "'z' AS `odd name`", "3 AS doc")
    for name, stage in P.STAGES[:-1]:
        plain, wide = (P.written(stage(spark, d, sf), name) for d in (docs, more))
        assert wide.columns == P.COLUMNS and sorted(map(str, wide.collect())) == sorted(map(str, plain.collect()))
        docs, more = plain, plain.selectExpr("*", "'x' AS score", "1 AS n_lines", "'y' AS component_id", "2 AS n_hit", "3 AS doc")
