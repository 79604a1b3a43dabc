"""Where results go: JSON, event tables, profiles, bounded logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.keyed_table import KeyedTable


def write_json(rows: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines, one object a row; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def record_scores(scores: DataFrame, path: str, source: str = "batch", at: str | None = None) -> None:
    """Append score events with the time of writing and their source, a folder a day; with `at`, the day is that of this column."""
    rows = scores.withColumns({"recorded_at": F.current_timestamp(), "source_tag": F.lit(source)}).withColumn("day", F.to_date(at or "recorded_at"))
    rows.repartition("day", F.pmod(F.monotonically_increasing_id(), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def record_feedback(feedback: DataFrame, path: str) -> None:
    """Append feedback with a known label (slop, reviewed, unsure); rows with another label are refused by an error that counts them."""
    odd = feedback.filter(~F.coalesce(F.col("user_label").isin("slop", "reviewed", "unsure"), F.lit(False))).count()
    if odd:
        raise ValueError(f"{odd} rows with an unknown label")
    feedback.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def upserted(profiles: DataFrame, changes: DataFrame, key: str = "user_id", order: str = "updated_at") -> DataFrame:
    """profiles after changes (the same columns): the row of each key with the largest order, of equal ones the changed one."""
    both = profiles.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    columns = F.struct(*(F.col(c) for c in profiles.columns))
    return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(columns, F.struct(order, "_new")).alias("row")).select("row.*")


def bounded(log: DataFrame, k: int = 250, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest k rows of a log."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(k)


def log_table(spark: SparkSession, path: str, schema: str, k: int = 250, order: tuple[str, ...] = ("ts", "event_id")) -> KeyedTable:
    """Stored logs, by a column `log`, that keep their newest k rows: upsert() appends, and a log that got rows is compacted and swapped in by the table's manifest."""

    def combine(rows: DataFrame) -> DataFrame:
        return newest_per_key(rows.drop("_new"), "log", k, *order)

    return KeyedTable(spark, path, schema, ["log"], combine, buckets=16)


def newest_per_key(log: DataFrame, key: str, k: int, *order: str, parts: int = 64) -> DataFrame:
    """The newest k rows of each key; each of `parts` parts of a key keeps its k before they meet."""
    by = [F.desc(c) for c in order]
    few = log.withColumn("_rn", F.row_number().over(Window.partitionBy(key, F.pmod(F.xxhash64(*order), F.lit(parts))).orderBy(*by))).filter(F.col("_rn") <= k)
    return few.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("_rn") <= k).drop("_rn")
