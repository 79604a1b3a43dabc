"""Baselines, relative scores, leaderboards, tickers and evaluation over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import rounded


def baselines(events: DataFrame) -> DataFrame:
    """(grain, domain, repo_id, author_id, n, mean, std, low, high): three grains by grouping sets in one shuffle.

    repo and author grains leave out rows without those ids; std is the sample deviation, 0 for one row.
    """
    keys = ["domain", "repo_id", "author_id"]
    sets = [["domain"], ["repo_id", "domain"], ["author_id", "repo_id", "domain"]]
    id_ = F.grouping_id()
    out = events.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.min("score").alias("low"), F.max("score").alias("high"), id_.alias("id")
    )
    grain = F.when(F.col("id") == 3, "global").when(F.col("id") == 1, "repo").otherwise("author")
    out = out.withColumn("grain", grain).filter(
        (F.col("grain") == "global") | ((F.col("grain") == "repo") & F.col("repo_id").isNotNull()) | (F.col("repo_id").isNotNull() & F.col("author_id").isNotNull())
    )
    return out.select("grain", *keys, "n", "mean", "std", "low", "high")


def normal_cdf(z: Column) -> Column:
    """Abramowitz-Stegun 7.1.26, exact to 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def relative_scores(events: DataFrame) -> DataFrame:
    """Each event against the baseline of its repo and its domain: means, percentiles, verdict, confidence."""
    base = baselines(events)
    glob = base.filter("grain = 'global'").select("domain", F.col("mean").alias("gm"), F.col("std").alias("gs"), F.col("n").alias("gn"))
    repo = base.filter("grain = 'repo'").select("domain", "repo_id", F.col("mean").alias("rm"), F.col("std").alias("rs"), F.col("n").alias("rn"))
    df = events.join(repo, ["domain", "repo_id"], "left").join(glob, "domain", "left")
    pct = lambda m, s: F.when(F.col(s) > 0, F.floor(normal_cdf((F.col("score") - F.col(m)) / F.col(s)) * 100 + 0.5)).cast("int")
    most = F.greatest(F.coalesce("rn", F.lit(0)), F.coalesce("gn", F.lit(0)))
    verdict = (
        F.when(F.col("score") > F.col("rm") + F.col("rs"), "above_repo").when(F.col("score") < F.col("rm") - F.col("rs"), "below_repo")
        .when(F.col("score") > F.col("gm") + F.col("gs"), "above_global").when(F.col("score") < F.col("gm") - F.col("gs"), "below_global").otherwise("typical")
    )
    confidence = F.when(most >= 20, "high").when(most >= 5, "medium").when(most >= 2, "low").otherwise("none")
    return df.select("event_id", "score", rounded(F.col("rm"), 4).alias("repo_mean"), pct("rm", "rs").alias("repo_percentile"), rounded(F.col("gm"), 4).alias("global_mean"),
                     pct("gm", "gs").alias("global_percentile"), verdict.alias("verdict"), confidence.alias("confidence"))


def running_baseline(events: DataFrame, key: str = "domain", every: str = "hour") -> DataFrame:
    """Mean and count up to and including each event of its key, by (ts, event_id), and whether it is below that mean.

    Each stretch of time has its own running sums; the sums of all stretches before come from one row a key and stretch. So
    a key's rows are never in one task, only its stretches are.
    """
    rows = events.withColumn("_at", F.date_trunc(every, "ts"))
    parts = rows.groupBy(key, "_at").agg(F.count("*").alias("_n"), F.sum("score").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum"))
    w = Window.partitionBy(key, "_at").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"_own": F.count("*").over(w), "_sums": F.sum("score").over(w)}).join(parts, [key, "_at"])
    out = out.withColumn("seen", F.col("_n") + F.col("_own")).withColumn("running_mean", (F.col("_sum") + F.col("_sums")) / F.col("seen"))
    return out.select("event_id", key, "score", "seen", rounded(F.col("running_mean") + 1e-9, 4).alias("running_mean"), (F.col("score") < F.col("running_mean") - 1e-9).alias("is_slop"))


def leaderboard(events: DataFrame, key: str, below: float) -> DataFrame:
    """(key, n, avg_score, slop_count, slop_pct) of each key."""
    slop = F.count_if(F.col("score") < below)
    return events.groupBy(key).agg(F.count("*").alias("n"), rounded(F.avg("score"), 4).alias("avg_score"), slop.alias("slop_count"), rounded(100 * slop / F.count("*"), 2).alias("slop_pct"))


def trend(events: DataFrame, key: str, newest: int = 5000) -> DataFrame:
    """Mean of the newest quarter of a key's latest rows less the mean of the rest.

    Each task's part of a key keeps its newest rows before they meet, so a key has a bounded number of rows in the last window.
    """
    order = [F.desc("ts"), F.desc("event_id")]
    part = Window.partitionBy(key, F.pmod(F.xxhash64("event_id"), F.lit(64))).orderBy(*order)
    df = events.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= newest)
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= newest).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    quarter = F.floor(F.col("n") / 4)
    return df.groupBy(key).agg(
        F.max("n").alias("n"), rounded(F.avg("score"), 4).alias("avg_score"),
        rounded(F.coalesce(F.avg(F.when(F.col("rn") <= quarter, F.col("score"))) - F.avg(F.when(F.col("rn") > quarter, F.col("score"))), F.lit(0.0)), 4).alias("trend"),
    )


def minute_history(events: DataFrame, every: str = "1 minute") -> DataFrame:
    bucket = F.window("ts", every)
    return events.groupBy(bucket).agg(F.count("*").alias("n"), rounded(F.avg("score"), 4).alias("avg_score")).select(F.col("window.start").alias("bucket"), "n", "avg_score")


def ticker(events: DataFrame, every: str = "1 hour") -> DataFrame:
    """Per domain and window: count, mean, and delta = mean of the window before - mean of this one."""
    cells = events.groupBy("domain", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy("domain").orderBy("w.start"))
    return cells.select("domain", F.col("w.start").alias("bucket"), "n", rounded(F.col("mean"), 4).alias("mean"), rounded(F.coalesce(before - F.col("mean"), F.lit(0.0)), 4).alias("delta"))


def share_of_total(events: DataFrame, key: str) -> DataFrame:
    counts = events.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "n", rounded(100 * F.col("n") / F.col("total"), 2).alias("pct"))  # total is one row


def confusion(rows: DataFrame, cut: float) -> DataFrame:
    """(domain or null for all, tp, tn, fp, fn, precision, recall, f1, accuracy, gap); low scores mean slop (quality 0)."""
    says, is_ = F.col("score") < cut, F.col("quality") == 0
    df = rows.rollup("domain").agg(
        F.count_if(says & is_).alias("tp"), F.count_if(~says & ~is_).alias("tn"), F.count_if(says & ~is_).alias("fp"), F.count_if(~says & is_).alias("fn"),
        F.avg(F.when(is_, F.col("score"))).alias("slop"), F.avg(F.when(~is_, F.col("score"))).alias("reviewed"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.select(
        "domain", "tp", "tn", "fp", "fn", rounded(ratio(tp, tp + fp), 4).alias("precision"), rounded(ratio(tp, tp + fn), 4).alias("recall"),
        rounded(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"), rounded(ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"),
        rounded(F.coalesce(F.col("reviewed") - F.col("slop"), F.lit(0.0)), 4).alias("gap"),
    )


def slop_velocity(events: DataFrame) -> DataFrame:
    """Weekly mean and count of each repo and the change from the week before."""
    week = events.groupBy("repo_id", F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    change = F.col("mean") - F.lag("mean").over(Window.partitionBy("repo_id").orderBy("week"))
    return week.select("repo_id", "week", "n", rounded(F.col("mean"), 4).alias("mean"), rounded(F.coalesce(change, F.lit(0.0)), 4).alias("change"))


def worst(events: DataFrame, k: int) -> DataFrame:
    return events.orderBy("score", "event_id").limit(k)


def latest(events: DataFrame, k: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def webhook_matches(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """(event_id, hook_id) where a hook's trigger fires; hooks are exploded to their domains first, so it is an equi-join.

    An empty domain list stands for `domains` of all events.
    """
    spread = hooks.select("hook_id", "trigger", "threshold", F.explode("domains").alias("domain"))
    fires = ((F.col("trigger") == "score_below") & (F.col("score") < F.col("threshold"))) | ((F.col("trigger") == "score_above") & (F.col("score") > F.col("threshold")))
    return events.join(spread, "domain").filter(fires).select("event_id", "hook_id")


def _composed(batches):
    """One row a domain of a sorted partition: its steps as one map x -> min(high, max(low, x + shift)), in hundredths."""
    import pyarrow as pa

    domain, first, out, low, high, shift = None, None, [], 0, 0, 0
    for batch in batches:
        for d, key, step in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if first is None or d != domain:
                if first is not None:
                    out.append((domain, first, shift, low, high))
                domain, first, low, high, shift = d, key, 3000, 7000, 0
            low, high, shift = min(7000, max(3000, low + step)), min(7000, max(3000, high + step)), shift + step
    if first is not None:
        out.append((domain, first, shift, low, high))
        types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["domain", "first", "shift", "low", "high"])


def adapt_thresholds(feedback: DataFrame, start: float = 48.0) -> DataFrame:
    """(domain, threshold): each feedback row moves it by 0.05 times plus or minus min(2, 2 confidence), between 30 and 70.

    Rows go by (ts, id). A step is a whole number of hundredths, and clamped shifts compose into one, so each range of rows
    becomes one row a domain, and only these few are folded in one place.
    """
    step = F.when(F.col("was_too_harsh"), -1).otherwise(1) * F.least(F.lit(2.0), 2 * F.col("confidence")) * 0.05
    key = F.struct("ts", "id", F.floor(step * 100 + 0.5).cast("long").alias("step"))
    rows = feedback.select("domain", key.alias("key")).select("domain", "key", "key.step")
    ranges = rows.repartitionByRange("domain", "key").sortWithinPartitions("domain", "key")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = ranges.mapInArrow(_composed, f"domain {kinds['domain']}, first {kinds['key']}, shift long, low long, high long")
    parts = parts.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("first", "shift", "low", "high"))).alias("parts"))
    fold = F.aggregate("parts", F.lit(round(start * 100)).cast("long"), lambda a, p: F.greatest(p["low"], F.least(p["high"], a + p["shift"])))
    return parts.select("domain", (fold / 100).alias("threshold"))


def repo_profiles(events: DataFrame) -> DataFrame:
    """(repo_id, domain, sample_count, mean_score, std_dev, min_score, max_score, authors): authors as (author_id, sample_count, mean_score), most active first."""
    author = events.filter(F.col("author_id").isNotNull()).groupBy("repo_id", "domain", "author_id").agg(F.count("*").alias("n"), rounded(F.avg("score"), 1).alias("mean"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "author_id", "mean"))), lambda x: F.struct(x["author_id"].alias("author_id"), (-x["o"]).alias("sample_count"), x["mean"].alias("mean_score")))
    authors = author.groupBy("repo_id", "domain").agg(listed.alias("authors"))
    whole = events.filter(F.col("repo_id").isNotNull()).groupBy("repo_id", "domain").agg(
        F.count("*").alias("sample_count"), rounded(F.avg("score"), 1).alias("mean_score"), rounded(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 2).alias("std_dev"),
        rounded(F.min("score"), 1).alias("min_score"), rounded(F.max("score"), 1).alias("max_score"),
    )
    return whole.join(authors, ["repo_id", "domain"], "left")


def user_summaries(events: DataFrame, newest: int = 50) -> DataFrame:
    """(author_id, total_scored, average_score, low_percent, domains) over the newest events of each author; domains maps to means, low is under 47."""
    order = [F.desc("ts"), F.desc("event_id")]
    part = Window.partitionBy("author_id", F.pmod(F.xxhash64("event_id"), F.lit(64))).orderBy(*order)  # the newest of each part of an author before they meet
    df = events.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= newest)
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy("author_id").orderBy(*order))).filter(F.col("rn") <= newest)
    cells = df.groupBy("author_id", "domain").agg(F.count("*").alias("n"), F.sum("score").alias("sum"), F.count_if(F.col("score") < 47).alias("low"))
    pairs = F.sort_array(F.collect_list(F.struct("domain", rounded(F.col("sum") / F.col("n"), 1).alias("mean"))))
    return cells.groupBy("author_id").agg(
        F.sum("n").alias("total_scored"), rounded(F.sum("sum") / F.sum("n"), 1).alias("average_score"), rounded(100 * F.sum("low") / F.sum("n"), 1).alias("low_percent"), pairs.alias("domains")
    )


def personal_summary(events: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k hosts (key) with the lowest mean: (key, average_score, count); ties by name."""
    return events.groupBy(key).agg(rounded(F.avg("score"), 1).alias("average_score"), F.count("*").alias("count")).orderBy("average_score", key).limit(k)


def repo_leaderboard(events: DataFrame, org: str = "", newest: int = 5000, k: int = 50) -> DataFrame:
    """(repo, score, reviewer_impact, pr_count) of the newest changes (url, score, signals), by owner/repo of the url; impact 0.5 where no signal tells it."""
    impact = F.coalesce(F.get(F.filter("signals", lambda s: s["name"] == "reviewer_impact_proxy"), F.lit(0))["score"], F.lit(0.5))
    rows = latest(events, newest).withColumns({"repo": owner_repo(F.col("url")), "impact": impact}).filter((F.col("repo") != "") & F.col("repo").startswith(f"{org}/" if org else ""))
    out = rows.groupBy("repo").agg(rounded(F.avg("score"), 1).alias("score"), rounded(F.avg("impact"), 2).alias("reviewer_impact"), F.count("*").alias("pr_count"))
    return out.orderBy(F.desc("score"), "repo").limit(k)


def owner_repo(url: Column) -> Column:
    """owner/repo of a code host's url, or an empty string."""
    return F.regexp_extract(url, r"github\.com/([^/]+/[^/]+)", 1)


def ingestion_stats(events: DataFrame, below: float) -> DataFrame:
    """(kind, key, n, slop_count, slop_rate, items_per_minute): one row for all events (kind total), with the rate between the first and the last of them, and one for each domain and repo_id; a null key is a key."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in (("total", F.lit("")), ("domain", F.col("domain")), ("repo_id", F.col("repo_id")))))
    rows = events.select("ts", "score", F.explode(kinds).alias("k")).groupBy("k.kind", "k.key").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") < below).alias("slop"), F.min(F.col("ts").cast("timestamp")).alias("first"), F.max(F.col("ts").cast("timestamp")).alias("last")
    )
    minutes = F.greatest((F.unix_micros("last") - F.unix_micros("first")) / 60e6, F.lit(0.01))
    rate = F.when(F.col("kind") == "total", rounded(F.col("n") / minutes, 1))
    return rows.select("kind", "key", "n", F.col("slop").alias("slop_count"), rounded(F.col("slop") / F.col("n"), 3).alias("slop_rate"), rate.alias("items_per_minute"))


def ticker_snapshot(events: DataFrame, seconds: int = 60) -> DataFrame:
    """One row for the last `seconds` up to the newest event: total, slop_rate, top_domain (most events), hottest_repo and its count and mean, previous_mean.

    Slop is under the mean of all events of the domain. Ties by name. Empty without events: the ticker is warming up.
    """
    now = events.agg(F.max("ts").alias("now"))
    base = events.groupBy("domain").agg(F.avg("score").alias("usual"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    rows = events.join(F.broadcast(now)).withColumn("age", age).filter(F.col("age") <= 2 * seconds).join(F.broadcast(base), "domain")  # one row; one a domain
    recent = F.col("age") <= seconds
    repos = rows.filter(recent).groupBy("repo_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    domains = rows.filter(recent).groupBy("domain").agg(F.count("*").alias("n"))
    hot = repos.agg(F.min(F.struct((-F.col("n")).alias("o"), "repo_id", "mean")).alias("h"))
    top = domains.agg(F.min(F.struct((-F.col("n")).alias("o"), "domain")).alias("d"))
    out = rows.agg(
        F.count_if(recent).alias("total"), F.count_if(recent & (F.col("score") < F.col("usual") - 1e-9)).alias("slop"),
        F.avg(F.when(recent, F.col("score"))).alias("mean"), F.avg(F.when(~recent, F.col("score"))).alias("before"),
    )
    out = out.join(F.broadcast(hot)).join(F.broadcast(top))
    return out.select(
        "total", rounded(F.col("slop") / F.greatest("total", F.lit(1)), 2).alias("slop_rate"), F.col("d.domain").alias("top_domain"), F.col("h.repo_id").alias("hottest_repo"),
        (-F.col("h.o")).alias("hottest_count"), rounded(F.col("h.mean"), 1).alias("hottest_avg"), rounded(F.col("mean"), 1).alias("avg_score"), rounded(F.col("before"), 1).alias("previous_avg"),
    )


def history_summary(history: DataFrame) -> DataFrame:
    """(total_minutes, current_avg_score): the mean of the means of minute_history()."""
    return history.agg(F.count("*").alias("total_minutes"), rounded(F.avg("avg_score"), 1).alias("current_avg_score"))


def tally(votes: DataFrame, least: int = 5) -> DataFrame:
    """(appeal_id, upvotes, downvotes, status) of votes (appeal_id, vote): settled from `least` votes on, verified if most say up."""
    out = votes.groupBy("appeal_id").agg(F.count_if(F.col("vote") == "up").alias("upvotes"), F.count_if(F.col("vote") != "up").alias("downvotes"))
    settled = F.when(F.col("upvotes") > F.col("downvotes"), "community_verified").otherwise("community_disputed")
    return out.withColumn("status", F.when(F.col("upvotes") + F.col("downvotes") >= least, settled).otherwise("pending"))


def label_counts(rows: DataFrame, group: str, label: str, labels: list) -> DataFrame:
    """One row a group with the count of each label as a column."""
    return rows.groupBy(group).agg(*(F.count_if(F.col(label) == v).alias(f"n_{v}") for v in labels))


def calibration(scores: DataFrame, bounds: DataFrame) -> DataFrame:
    """(name, checks, failed, passed) of cases: scores (name, measure, value) against bounds (name, measure, low, high; either may be null).

    A measure that a case lacks counts as -1.
    """
    df = bounds.join(scores, ["name", "measure"], "left").withColumn("value", F.coalesce("value", F.lit(-1.0)))
    ok = F.coalesce(F.col("value") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("high"), F.lit(True))
    return df.groupBy("name").agg(F.count("*").alias("checks"), F.count_if(~ok).alias("failed"), F.every(ok).alias("passed"))
