"""A corpus from raw documents: language ID, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, with the decisions of the stage carried out. Its result is to be written before the next stage of the run starts, which deletes
the intermediate tables that the stage before made, and no others. Runs in several threads, or over several folders, do not meet. Null and empty texts have no language and go in the first stage; repeated rows
pass as often as they come until near_dedup, which keeps all rows of the smallest doc_id of a group; empty tables give empty ones;
texts of any length are read whole; columns beside those of documents are dropped.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import read_table, written
from textloom.llm.decontaminate import decontaminate
from textloom.llm.jaccard_join import jaccard_join
from textloom.llm.language_id import identify, learn_from, train_on
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.packing import pack, tokenize
from textloom.sources.scratch import Scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Documents whose language is less likely than this go; all languages alike have 1 / languages.
MIN_SCORE = 0.4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the last stage of a run made, by thread and folder.
_MADE: dict[tuple[int, str], Scope] = {}


def _stage(first: bool = False) -> Callable[[Stage], Stage]:
    """A stage that owns its intermediate tables, and deletes those of the stage before, whose result is written by then. The first has none before it."""

    def mark(f: Stage) -> Stage:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            run_of = (threading.get_ident(), sf_dir)
            before = _MADE.pop(run_of, None)
            if before and not first:
                before.delete(spark)
            with Scope() as scope:
                out = f(spark, docs, sf_dir)
            _MADE[run_of] = scope
            return out

        return run_stage

    return mark


@_stage(first=True)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model knows; lang is the predicted one."""
    found = identify(docs.select(*COLUMNS), train_on(learn_from(docs)))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage()
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a smaller doc_id holds; documents with nothing left go."""
    left = dedup_lines(docs.select(*COLUMNS)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@_stage()
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates (five-word shingles, Jaccard 0.8), and documents without words."""
    found = jaccard_join(docs.select(*COLUMNS), width=5, percent=80)
    return found.filter((F.col("n_shingles") == 0) | F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(*COLUMNS)


@_stage()
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*COLUMNS)


@_stage()
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    import public_tokenizers

    return pack(tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: A trained network and a tokenizer have no SQL; tests hold what each stage decides, and its operator is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the written result of a stage is deleted when that of the next is there, but the last, which the pieces are read from."""
    docs, read = read_table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            with Scope() as result:
                docs = written(docs, name)
            if read:
                read.delete(spark)
            read = result
    return docs
