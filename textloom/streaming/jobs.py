"""Streaming forms of the score analytics; each takes a streaming DataFrame of (ts, event_id, domain, score)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_landing(spark: SparkSession, path: str, schema, files_per_trigger: int = 10) -> DataFrame:
    """A folder that sources drop Parquet files into."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need an instant; times without a zone are in that of the session."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def unique(events: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Drop repeated event ids that come within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def window_scores(events: DataFrame, every: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Count and mean of each domain and window, final once the watermark has passed it."""
    w = F.window("ts", every)
    return _timed(events, late).groupBy(w, "domain").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).select(F.col("window.start").alias("bucket"), "domain", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return _timed(events, late).groupBy(w, "author_id").agg(F.count("*").alias("n")).select("author_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_baselines(events: DataFrame) -> DataFrame:
    """Per domain (n, mean, std) so far, kept as a mergeable state of count, mean and squared distance."""

    def step(key, batches, state):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in batches:
            k, m = len(pdf), float(pdf["score"].mean())
            s = float(((pdf["score"] - m) ** 2).sum())
            total = n + k
            m2 += s + (m - mean) ** 2 * n * k / total
            mean += (m - mean) * k / total
            n = total
        state.update((n, mean, m2))
        yield pd.DataFrame({"domain": [key[0]], "n": [n], "mean": [mean], "std": [(m2 / (n - 1)) ** 0.5 if n > 1 else 0.0]})

    return events.select("domain", "score").groupBy("domain").applyInPandasWithState(step, "domain string, n long, mean double, std double", "n long, mean double, m2 double", "update", "NoTimeout")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return it as a table (tests, backfills)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
