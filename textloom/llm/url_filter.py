"""URL filter by the ratio of two character language models (operator 9), DataFrame operations only.

Rules decide the URLs they fit and label the training data: accepted and rejected URLs. For either class all
characters of all distinct labelled URLs, query string and fragment included, are counted after contexts of every
length up to `order`; a character's probability interpolates from the longest context down (Witten-Bell: a context
with many different followers trusts the shorter one more). A URL's score is the mean over its characters of
log p(accepted) - log p(rejected).

The threshold is calibrated on URLs that the models have not seen: labelled URLs are dealt to two folds, each fold is
scored by models of the other, and the threshold lies between the means of the two classes, nearer to the one that
scatters less. Where a fold lacks one of the classes it is 0, where both are equally likely.

The models are tables. Each distinct gram is scored once at each length, from the score of the next shorter one, and
URLs join the scores of the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import ngrams
from textloom.llm.common import UPPER, read_table, written

#: (verdict, host, start of the path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Characters that a model tells apart at most, for the base of the interpolation.
SYMBOLS = 256.0


def url_parts(url: str) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to /, ?, # or the end, A-Z lower-cased; path from there up to ? or #."""
    c = F.col(url)
    at = F.locate("://", c)
    rest = F.when(at > 0, F.substring(c, at + 3, F.char_length(c))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest) + 1), r"^[^?#]*+", 0)
    none = c.isNull()
    return F.when(none, "").otherwise(F.translate(host, UPPER, UPPER.lower())), F.when(none, "").otherwise(path)


def fitting_rule(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else null."""
    rule = verdict = None
    for kind, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _grams(text: Column, longest: int) -> Column:
    """For every character of text, the `longest` characters that end with it, padded at the start."""
    padded = F.concat(F.lit("\x02" * (longest - 1)), text, F.lit("\x03"))
    return ngrams(padded, longest)


def gram_scores(labelled: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log p(last character | the others) for accepted less rejected URLs."""
    seen = labelled.select("verdict", F.explode(_grams(F.col("shown"), order + 1)).alias("gram")).groupBy("verdict", "gram").agg(F.count("*").alias("n"))
    size = F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("size")
    by_size = seen.select("verdict", "n", "gram", size).groupBy(F.expr("right(gram, size)").alias("gram"), "size").agg(
        *(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block"))
    )
    by_size = written(by_size, "grams")
    context = by_size.groupBy(F.expr("left(gram, size - 1)").alias("context"), "size").agg(
        *(F.sum(v).alias(f"n_{v}") for v in ("allow", "block")), *(F.sum((F.col(v) > 0).cast("int")).alias(f"t_{v}") for v in ("allow", "block"))
    )
    context = written(context, "contexts")

    def step(v: str) -> Column:
        n, t = F.coalesce(f"n_{v}", F.lit(0)), F.coalesce(f"t_{v}", F.lit(0))
        return F.when(n + t == 0, F.col(f"p_{v}")).otherwise((F.coalesce(v, F.lit(0)) + t * F.col(f"p_{v}")) / (n + t)).alias(f"p_{v}")

    # from the shortest context up: a level has each of its grams once, so a key meets at most an alphabet of rows
    shorter = None
    for k in range(1, order + 2):
        level = grams.select(F.right("gram", F.lit(k)).alias("gram")).distinct().withColumn("context", F.left("gram", F.lit(k - 1)))
        if shorter is None:
            level = level.withColumns({"p_allow": F.lit(1.0 / SYMBOLS), "p_block": F.lit(1.0 / SYMBOLS)})
        else:
            level = level.withColumn("shorter", F.right("gram", F.lit(k - 1))).join(shorter.withColumnRenamed("gram", "shorter"), "shorter")
        counts, sums = (t.filter(F.col("size") == k).drop("size") for t in (by_size, context))
        shorter = level.join(counts, "gram", "left").join(sums, "context", "left").select("gram", step("allow"), step("block"))
    return shorter.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def mean_scores(grams: DataFrame, labelled: DataFrame, order: int, name: str) -> DataFrame:
    """(key, score): the mean ratio of the grams (key, gram) of each URL under models of the labelled URLs."""
    scores = written(gram_scores(labelled, written(grams.select("gram").distinct(), f"{name}_grams"), order), f"{name}_ratios")
    return grams.join(scores, "gram").groupBy("key").agg(F.avg("ratio").alias("score"))


def threshold(labelled: DataFrame, grams: DataFrame, order: int) -> float | None:
    """The calibrated score that parts accepted from rejected URLs; None where a class has no URLs at all."""
    there = {(r["verdict"], r["fold"]) for r in labelled.select("verdict", "fold").distinct().collect()}  # four at most
    if len({v for v, _ in there}) < 2:
        return None
    if len(there) < 4:
        return 0.0
    held_out = None
    for fold in (0, 1):
        own = labelled.filter(F.col("fold") == fold).select("key", "verdict")
        scored = mean_scores(grams.filter(F.col("verdict").isNotNull() & (F.col("fold") == fold)), labelled.filter(F.col("fold") != fold), order, f"fold_{fold}").join(own, "key")
        held_out = scored if held_out is None else held_out.unionByName(scored)
    a, b = (r for r in held_out.groupBy("verdict").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).orderBy("verdict").collect())
    scatter = a["s"] + b["s"]
    return (a["m"] * b["s"] + b["m"] * a["s"]) / scatter if scatter else (a["m"] + b["m"]) / 2


def filter_urls(pages: DataFrame, *, rules=RULES, order: int = 4) -> DataFrame:
    """Returns page_id, host, path, rule, verdict, score; one row per row of pages (page_id, url).

    A URL that no rule fits is blocked if its score is below the threshold. Without accepted or without
    rejected URLs to learn from, such a URL is allowed. A null or odd URL has empty host and path; its score is that of
    the whole string, null as empty. Score: null where nothing was learned. A score equal to the threshold is allowed.
    Models read the host in lower case and all that follows, so URLs that differ after ? or # differ in score.
    Repeated rows are each returned, and a distinct URL (told apart by 128 bits) counts once in the models. URLs of any
    length are read whole; other columns are ignored.
    """
    host, path = url_parts("url")
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    at = F.locate("://", F.col("url"))
    rest = F.substring(F.col("url"), at + 3 + F.char_length("host"), F.char_length("url"))
    own = own.withColumn("shown", F.coalesce(F.when(at > 0, F.concat("host", rest)).otherwise(F.col("url")), F.lit("")))
    own = own.withColumn("key", F.md5(F.concat_ws("\n", F.octet_length("host"), F.octet_length("path"), "shown")))
    own = written(own.drop("url"), "urls")
    rule, verdict = fitting_rule(rules)
    urls = own.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("shown").alias("shown"))
    urls = urls.withColumns({"rule": rule, "verdict": verdict, "fold": F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(2))}).drop("host", "path")
    urls = written(urls, "distinct_urls")
    labelled = urls.filter(F.col("verdict").isNotNull())
    grams = urls.select("key", "verdict", "fold", F.explode(_grams(F.col("shown"), order + 1)).alias("gram"))
    scored = mean_scores(grams, labelled, order, "all")
    cut = threshold(labelled, grams, order)
    judged = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    verdicts = urls.join(scored, "key").select("key", "rule", F.coalesce("verdict", judged).alias("verdict"), "score")
    return own.join(verdicts, "key").select("page_id", "host", "path", "rule", "verdict", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of all pages; see filter_urls() for odd rows."""
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("score")
