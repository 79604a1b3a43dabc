"""Readers of labelled samples and pages, and the documents-to-engine mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.lexicons import DOMAINS, SAMPLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(label, domain, text) of a JSON array or JSON lines; accepts other key names and labels of the same meaning."""
    schema = "label string, human_or_chatgpt string, text string, sentence string, domain string"
    df = spark.read.schema(schema).json(path, multiLine=not lines)
    label = F.lower(F.coalesce("label", "human_or_chatgpt"))
    label = F.when(label == "chatgpt", "slop").when(label == "human", "reviewed").otherwise(label)
    return df.select(label.alias("label"), F.coalesce("domain", F.lit("general")).alias("domain"), F.coalesce("text", "sentence").alias("text")).filter(F.col("text").isNotNull())


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as documents."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def domain_of(doc_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (doc_id % len(DOMAINS) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with domain, repo_id, author_id; a sample sentence follows each text, so that every list is met."""
    docs = table(spark, sf_dir, "documents")
    extra = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("doc_id") % len(SAMPLES) + 1).cast("int"))
    return docs.select("doc_id", F.concat_ws(" ", "text", extra).alias("text"), domain_of(F.col("doc_id")).alias("domain"), F.col("source").alias("repo_id"), F.col("lang").alias("author_id"))


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scores: (event_id, ts, domain, repo_id, author_id, score)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("domain"), F.concat(F.lit("repo"), (F.col("user_id") % 20).cast("string")).alias("repo_id"),
                    F.col("user_id").cast("string").alias("author_id"), F.col("value").alias("score"))


def host_domain(url: Column) -> Column:
    """The kind of writing a host carries, by the first name that it contains."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    kinds = [("git", "code_review"), ("docs", "docs"), ("blog", "content"), ("arxiv", "academia"), ("shop", "marketplace"), ("news", "social_news")]
    out = F.when(F.lit(False), "")
    for part, kind in kinds:
        out = out.when(host.contains(part), kind)
    return out.otherwise("general")


def newest_scores(spark: SparkSession, path: str, k: int, columns: list[str], order: tuple[str, ...] = ("ts", "event_id"), where: dict | None = None) -> DataFrame:
    """The newest k events of the folders that record_scores() writes, with those columns; `where` has values that columns must equal.

    Days are counted first, from the columns of `where` alone, and only the newest that hold k rows are read: the scan has them as partition filter,
    `where` as pushed filter, and no other columns. Each task keeps its k newest rows, so k rows a task are all that meet.
    """
    rows = spark.read.parquet(path)
    for c, v in (where or {}).items():
        rows = rows.filter(F.col(c) == v)
    first, left = None, k
    for day, n in rows.groupBy("day").count().orderBy(F.desc("day")).collect():  # a row a day
        first, left = day, left - n
        if left <= 0:
            break
    if first is None:
        return rows.select(*columns).limit(0)
    kept = rows.filter(F.col("day") >= F.lit(first)) if left <= 0 else rows
    return kept.select(*{*columns, *order}).orderBy(*(F.desc(c) for c in order)).limit(k).select(*columns)
