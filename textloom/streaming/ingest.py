"""Continuous scoring with stored state: score and store, candidate phrases, adapted thresholds, the ticker.

Every job is a function of a streaming DataFrame that returns a StreamingQuery, or the DataFrame to write; each has a batch form that gives
the same rows over the same events. Checkpoints, feeds and tables are in shared folders. Jobs with keyed state need the RocksDB state store,
which the caller sets for the session (ROCKSDB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textloom.functions import lexicons as L
from textloom.functions.text import rounded, settled, strip
from textloom.sources.keyed_table import KeyedTable, summed

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _started(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there in micro-batches."""
    return df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- score and store ---------------------------------------------------------------------------------------------------

SHORTEST = 20
COUNTERS = "kind string, key string, n long, last timestamp"


def counters(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """(kind, key, n, last): the rows taken in, scored, scored low, and scored of each domain and source, with the newest time of scored rows; a null key is a key."""
    seen = docs.agg(F.count("*").alias("n")).select(F.lit("ingested").alias("kind"), F.lit("").alias("key"), "n", F.lit(None).cast("timestamp").alias("last"))
    kinds = F.array(F.struct(F.lit("scored").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("key")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")))
    rows = scores.select("ts", F.explode(F.when(F.col("oversight") == "low", F.concat(kinds, F.array(F.struct(F.lit("low").alias("kind"), F.lit("").alias("key"))))).otherwise(kinds)).alias("k"))
    return seen.unionByName(rows.groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), F.max("ts").alias("last")))


def feed_rows(docs: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The feed of documents (doc_id, ts, domain, source, title, text): those of SHORTEST characters and more without blanks at the ends, with title and text cut for display, score and oversight."""
    kept = docs.filter(F.char_length(strip(F.col("text"))) >= SHORTEST)
    return score(kept).select("doc_id", "ts", "domain", "source", F.left("title", F.lit(120)).alias("title"), F.left("text", F.lit(200)).alias("text_preview"), "score", "oversight")


def counter_table(spark, path: str) -> KeyedTable:
    return KeyedTable(spark, path, COUNTERS, ["kind", "key"], summed(["kind", "key"], ["n"], ["last"]), buckets=8)


def score_and_store(docs: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, after: Callable[[str], None] | None = None) -> StreamingQuery:
    """Score a stream of documents into path/feed, a folder a micro-batch, and count them in path/counters.

    A batch that is run again after a crash replaces its own folder, and the counters know the last batch that they have; so nothing is lost
    or counted twice. `after` is told each step that is done. Readers of the feed take the batches up to that of the counters: read_feed().
    """
    spark = docs.sparkSession
    table = counter_table(spark, f"{path}/counters")

    def each(batch: DataFrame, number: int) -> None:
        if table.applied("feed", number):
            return
        folder = f"{path}/feed/batch={number}"
        feed_rows(batch, score).write.mode("overwrite").parquet(folder)
        if after:
            after("feed")
        table.upsert(counters(batch, spark.read.parquet(folder)), "feed", number)
        if after:
            after("counters")

    return _started(docs, checkpoint, each)


def read_feed(spark, path: str) -> DataFrame:
    """The rows of all batches that are counted, with their batch."""
    last = counter_table(spark, f"{path}/counters").manifest()["batches"].get("feed", -1)
    return spark.read.parquet(f"{path}/feed").filter(F.col("batch") <= last)


# ---- candidate phrases -------------------------------------------------------------------------------------------------

LOW = 48.0
PER_TEXT = 5
EXAMPLES = 3
READY = 3
#: Parts of a phrase's state, so that the documents of a frequent one are in many tasks.
PARTS = 16
PATTERN_STATE = "phrase string, part int, n long, first_seen timestamp, last_seen timestamp, examples array<struct<ts:timestamp,doc_id:long,text:string>>, sources array<string>, asked timestamp"


def candidate_phrases(text: Column, words: Column, most: int = PER_TEXT, filler: list[str] = L.FILLER) -> Column:
    """The first `most` phrases of 2 to 6 words (all of 2 words first) of 8 to 60 characters with a filler word, without digits and known slop. words: the words of the text, in lower case.
    A filler has two words at most, and may be a part of a word.

    Only starts within reach of a filler are looked at.
    """
    n, any_filler = F.size(words), "|".join(filler)
    pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
    at = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: pair(i).rlike(any_filler))
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - 5, F.lit(0)), i)))))
    fits = lambda p: (F.char_length(p).between(8, 60)) & p.rlike(any_filler) & ~p.rlike(r"\p{Nd}") & ~p.rlike(L.KNOWN_SLOP)
    grams = lambda k: F.filter(F.transform(F.filter(starts, lambda s: s + k <= n), lambda s: F.array_join(F.slice(words, s + 1, F.lit(k)), " ")), fits)
    return F.when(F.lower(text).rlike(any_filler), F.slice(F.concat(*(grams(k) for k in range(2, 7))), 1, most)).otherwise(F.array().cast("array<string>"))


def candidates(docs: DataFrame, filler: list[str] = L.FILLER) -> DataFrame:
    """(phrase, doc_id, ts, source, text): the candidate phrases of documents (doc_id, ts, source, text, score) that score under LOW, a row each time; text is cut for display."""
    low = docs.filter(F.col("score") < LOW).select("doc_id", "ts", "source", "text", F.regexp_extract_all(F.lower("text"), F.lit(r"\S+"), F.lit(0)).alias("words"))
    return settled(low).select("doc_id", "ts", "source", F.left("text", F.lit(100)).alias("text"), F.explode(candidate_phrases(F.col("text"), F.col("words"), filler=filler)).alias("phrase"))


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")


def _combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One state a key of rows with states."""
    examples = F.slice(F.sort_array(F.flatten(F.collect_list("examples"))), 1, EXAMPLES)
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources"))))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), examples.alias("examples"), sources.alias("sources"), F.max("asked").alias("asked"))


def listing(states: DataFrame, ready_only: bool = False) -> DataFrame:
    """(phrase, n, first_seen, last_seen, examples, sources, ready, promoted) of states: ready from READY times on; promoted if that was asked for when the phrase had been seen."""
    whole = _combined(states, ["phrase"]).filter("n > 0")  # PARTS rows a phrase
    out = whole.select("phrase", "n", "first_seen", "last_seen", F.col("examples.text").alias("examples"), "sources", (F.col("n") >= READY).alias("ready"), F.coalesce(F.col("asked") >= F.col("first_seen"), F.lit(False)).alias("promoted"))
    return out.filter("ready") if ready_only else out


def pattern_states(docs: DataFrame, promotions: DataFrame, filler: list[str] = L.FILLER) -> DataFrame:
    """The states of all phrases of documents, as PATTERN_STATE; promotions (phrase, ts). The batch form of pattern_stream().

    Sources are one row a phrase, part and source before they are listed, and examples are ranked, so no list is longer than there are sources or EXAMPLES.
    """
    rows = candidates(docs, filler).withColumn("part", _part())
    key = ["phrase", "part"]
    sources = rows.filter("source IS NOT NULL AND source <> ''").select(*key, "source").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("source")).alias("sources"))
    counted = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("ts", "doc_id", "text"))).filter(F.col("rn") <= EXAMPLES)
    examples = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ts", "doc_id", "text"))).alias("examples"))
    asked = promotions.groupBy("phrase").agg(F.max("ts").alias("asked")).withColumn("part", F.lit(0))
    out = counted.join(examples, key).join(sources, key, "left").join(asked, key, "full_outer")
    none = F.array().cast("array<string>")
    return out.select(*key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first_seen", "last_seen", F.coalesce("examples", F.array().cast("array<struct<ts:timestamp,doc_id:long,text:string>>")).alias("examples"), F.coalesce("sources", none).alias("sources"), "asked")


class Patterns(StatefulProcessor):
    """State of a part of a phrase: count and times, the first examples, a map of sources, when it was promoted; gone when it was not seen for `expire` seconds of event time."""

    def __init__(self, expire: float | None = None):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, first_seen timestamp, last_seen timestamp, asked timestamp")
        self.examples = handle.getListState("examples", "ts timestamp, doc_id long, text string")
        self.sources = handle.getMapState("sources", "source string", "last_seen timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, first, last, asked = self.seen.get() if self.seen.exists() else (0, None, None, None)
        examples = list(self.examples.get()) if self.examples.exists() else []
        for pdf in rows:
            asks = pdf["ts"][pdf["asks"]]
            asked = max([t for t in (asked, *asks) if t is not None], default=None)
            found = pdf[~pdf["asks"]]
            if not len(found):
                continue
            n += len(found)
            low, high = found["ts"].min(), found["ts"].max()
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
            examples = sorted([*examples, *found.nsmallest(EXAMPLES, ["ts", "doc_id"])[["ts", "doc_id", "text"]].itertuples(index=False, name=None)])[:EXAMPLES]
            for source, t in found[found["source"].fillna("") != ""].groupby("source")["ts"].max().items():
                self.sources.updateValue((source,), (t,))
        self.seen.update((n, first, last, asked))
        if examples:
            self.examples.put(examples)
        if self.expire is not None and last is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(int(last.timestamp() * 1000 + self.expire * 1000))
        yield self._row(key, n, first, last, examples, sorted(s[0] for s in self.sources.keys()) if n else [], asked)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked = self.seen.get()[3] if self.seen.exists() else None
        for state in (self.seen, self.examples, self.sources):
            state.clear()
        yield self._row(key, 0, None, None, [], [], asked)

    def _row(self, key, n, first, last, examples, sources, asked) -> pd.DataFrame:
        shown = [{"ts": t, "doc_id": d, "text": x} for t, d, x in examples]
        return pd.DataFrame({"phrase": [key[0]], "part": pd.Series([key[1]], dtype="int32"), "n": [n], "first_seen": pd.to_datetime([first]), "last_seen": pd.to_datetime([last]), "examples": [shown], "sources": [sources], "asked": pd.to_datetime([asked])})

    def close(self) -> None:
        pass


def pattern_table(spark, path: str, buckets: int = 64) -> KeyedTable:
    """The states as last sent, by phrase and part; later ones replace earlier ones, and states without a count are left out when listed."""
    combine = lambda rows: rows.groupBy("phrase", "part").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "_new")), "_new").alias("row")).select("row.*")
    return KeyedTable(spark, path, PATTERN_STATE, ["phrase", "part"], combine, buckets)


def pattern_stream(docs: DataFrame, promotions: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", expire: float | None = None, filler: list[str] = L.FILLER) -> StreamingQuery:
    """Keep the states of the phrases of a stream of documents in the table at path; listing() of its rows is the queue. promotions: a stream of (phrase, ts).

    With `expire`, a phrase goes when the watermark is that many seconds past its last time; without, rows of any age count and
    the stored states are those of pattern_states().
    """
    table = pattern_table(docs.sparkSession, path)
    rows = candidates(docs, filler).withColumns({"part": _part(), "asks": F.lit(False)})
    asks = promotions.select("phrase", "ts", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("part"), F.lit(True).alias("asks"))
    both = rows.unionByName(asks)
    if expire is not None:
        both = both.withWatermark("ts", late)
    states = both.groupBy("phrase", "part").transformWithStateInPandas(Patterns(expire), PATTERN_STATE, "Update", "None" if expire is None else "EventTime")
    return _started(states, checkpoint, lambda batch, number: table.upsert(batch, "patterns", number), "update")


# ---- thresholds --------------------------------------------------------------------------------------------------------

THRESHOLD_STATE = "domain string, threshold double, folded long, waiting long"


class Thresholds(StatefulProcessor):
    """State of a domain: the threshold in hundredths, and rows that may still be followed by earlier ones. A timer folds those that the watermark has passed, by (ts, id)."""

    def __init__(self, start: float):
        self.start = round(start * 100)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "threshold long, folded long")
        self.waiting = handle.getListState("waiting", "at long, id long, step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = [(int(a), int(i), int(s)) for a, i, s in zip(pdf["at"], pdf["id"], pdf["step"])]
            self.waiting.appendList(new)
            for second in {a // 1_000_000 for a, _, _ in new}:
                self.handle.registerTimer((second + 1) * 1000)  # one a second of event time
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < passed]
        if not ready:
            return
        threshold, folded = self.value.get() if self.value.exists() else (self.start, 0)
        for _, _, step in ready:
            threshold = max(3000, min(7000, threshold + step))
        self.value.update((threshold, folded + len(ready)))
        left = rows[len(ready) :]
        self.waiting.put(left) if left else self.waiting.clear()
        yield pd.DataFrame({"domain": [key[0]], "threshold": [threshold / 100], "folded": [folded + len(ready)], "waiting": [len(left)]})

    def close(self) -> None:
        pass


def threshold_stream(feedback: DataFrame, start: float = 48.0, late: str = "10 minutes") -> DataFrame:
    """(domain, threshold, folded, waiting) each time that a domain's threshold moves; feedback (domain, ts, id, was_too_harsh, confidence). The streaming form of adapt_thresholds().

    Rows wait until the watermark, the newest time less `late`, has passed them, so they are folded in the order of (ts, id) whatever the order
    in which they come; rows that come after that are dropped. The last rows of a feed wait for a row that is later by `late`.
    """
    step = F.when(F.col("was_too_harsh"), -1).otherwise(1) * F.least(F.lit(2.0), 2 * F.col("confidence")) * 0.05
    rows = feedback.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("domain", "ts", "id", F.floor(step * 100 + 0.5).cast("long").alias("step"), F.unix_micros("ts").alias("at"))
    return rows.groupBy("domain").transformWithStateInPandas(Thresholds(start), THRESHOLD_STATE, "Update", "EventTime")


# ---- ticker ------------------------------------------------------------------------------------------------------------


def ticker_windows(events: DataFrame, seconds: int = 60, every: int = 30, late: str | None = None) -> DataFrame:
    """(until, total, slop, slop_rate, avg_score, previous_avg, delta, top_domain, hottest_repo, hottest_count, hottest_avg): a row each `every` seconds, of the `seconds` before `until` and, as previous_avg, those before these.

    events (ts, domain, repo_id, score, is_slop), a table or a stream (then give `late`). Each event counts in the windows that hold it and, as an earlier one, in
    those that begin where these end; so one aggregation has both. A window without events of its own has no row; without any the ticker is warming up and has none. Ties by name.
    On a stream a window is final once the watermark has passed its end; rows that come later than `late` are left out of windows that are final.
    """
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    when = F.col("ts").cast("timestamp")
    both = F.array(F.struct(when.alias("at"), F.lit(True).alias("own")), F.struct((when + span).alias("at"), F.lit(False).alias("own")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("all", F.lit(None).cast("string")), ("domain", F.col("domain")), ("repo", F.col("repo_id")))))
    rows = events.select("domain", "repo_id", "score", "is_slop", F.explode(both).alias("e")).select("e.at", "e.own", "score", "is_slop", F.explode(kinds).alias("k"))
    if late is not None:  # times are ahead of those of the events by one window
        rows = rows.withWatermark("at", f"{pd.Timedelta(late).total_seconds() + seconds:.0f} seconds")
    own = F.col("own")
    cells = rows.groupBy(F.window("at", f"{seconds} seconds", f"{every} seconds").alias("w"), "k.kind", "k.key").agg(
        F.count_if(own).alias("n"), F.sum(F.when(own, F.col("score"))).alias("sum"), F.count_if(own & F.col("is_slop")).alias("slop"), F.avg(F.when(~own, F.col("score"))).alias("before"),
    )
    is_ = lambda kind: (F.col("kind") == kind) & (F.col("n") > 0)
    first = lambda kind: F.min(F.when(is_(kind) & F.col("key").isNotNull(), F.struct((-F.col("n")).alias("o"), "key", "sum")))
    whole = lambda c: F.max(F.when(F.col("kind") == "all", F.col(c))).alias(c)
    out = cells.groupBy(F.window(F.window_time("w"), f"{every} seconds").alias("w")).agg(*map(whole, ("n", "sum", "slop", "before")), first("domain").alias("domain"), first("repo").alias("repo"))
    mean = F.col("sum") / F.col("n")
    return out.filter("n > 0").select(
        F.col("w.end").alias("until"), F.col("n").alias("total"), "slop", rounded(F.col("slop") / F.col("n"), 2).alias("slop_rate"), rounded(mean, 1).alias("avg_score"), rounded(F.col("before"), 1).alias("previous_avg"),
        rounded(F.coalesce(F.col("before") - mean, F.lit(0.0)), 1).alias("delta"), F.col("domain.key").alias("top_domain"), F.col("repo.key").alias("hottest_repo"), (-F.col("repo.o")).alias("hottest_count"),
        rounded(F.col("repo.sum") / -F.col("repo.o"), 1).alias("hottest_avg"),
    )
