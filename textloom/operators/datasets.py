"""Builders of labelled datasets: dedup, caps, balance, weak labels, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_prefix(docs: DataFrame, chars: int = 80) -> DataFrame:
    """The smallest doc_id of each prefix of that many characters; null texts are one prefix."""
    return docs.groupBy(F.left(F.coalesce("text", F.lit("")), F.lit(chars)).alias("prefix")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def cap_per_group(rows: DataFrame, group: str, order: str, k: int, parts: int = 64) -> DataFrame:
    """The first k rows of each group. Each of `parts` parts of a group keeps its k before they meet, so a large group is never in one task."""
    part = Window.partitionBy(group, F.pmod(F.xxhash64(order), F.lit(parts))).orderBy(order)
    few = rows.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= k)
    return few.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("rn") <= k).drop("rn")


def balance(rows: DataFrame) -> DataFrame:
    """Per domain, at most max(3 x rows of quality 0, 10) rows of quality 1, by doc_id.

    The doc_id up to which rows stay comes from counts of doc_id ranges, so only the range with the last ones is ranked.
    """
    counts = rows.groupBy("domain").agg(F.count_if(F.col("quality") == 0).alias("slop"))
    most = F.greatest(3 * F.col("slop"), F.lit(10))
    good = rows.filter(F.col("quality") == 1)
    cut = F.floor(F.col("doc_id") / 4096)
    parts = good.groupBy("domain", cut.alias("range")).agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("domain").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.join(counts, "domain").filter(F.col("before") < most).select("domain", "range", "before", most.alias("most"))
    ranked = good.withColumn("range", cut).join(parts, ["domain", "range"]).withColumn("rank", F.row_number().over(Window.partitionBy("domain", "range").orderBy("doc_id")))
    kept = ranked.filter(F.col("before") + F.col("rank") <= F.col("most")).select("doc_id", "domain", "quality")
    return rows.filter(F.col("quality") == 0).select("doc_id", "domain", "quality").unionByName(kept)


def phrase_counts(docs: DataFrame, n: int, least: int, longest: int = 60) -> DataFrame:
    """(phrase, docs): word n-grams of 8 to `longest` characters without a digit, in at least `least` documents."""
    from textloom.functions.text import tokens

    toks = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    grams = F.when(F.size("t") < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, n), " ")))
    rows = toks.select(F.explode(F.array_distinct(grams)).alias("phrase")).filter(F.char_length("phrase").between(8, longest) & ~F.col("phrase").rlike("[0-9]"))
    return rows.groupBy("phrase").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)


def filler_phrases(docs: DataFrame, least: int, sizes: range = range(2, 7), longest: int = 60) -> DataFrame:
    """(phrase, docs): as phrase_counts, of all `sizes` in words, that hold a filler word and no known slop."""
    from textloom.functions import lexicons as L
    from textloom.functions.text import tokens

    filler, most, n = "|".join(L.FILLER), max(sizes), F.size("t")
    toks = docs.select(tokens(F.col("text")).alias("t")).filter(F.array_join("t", " ").rlike(filler))
    # fillers have one or two words: where one starts, and then only the phrases around it
    at = toks.select("t", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", F.get("t", i), F.get("t", i + 1)).rlike(filler)).alias("at"))
    fits = lambda i, s: F.filter(F.array(*map(F.lit, sizes)), lambda k: (s + k > i) & (s + k <= n))
    grams = lambda i, s: F.transform(fits(i, s), lambda k: F.array_join(F.slice("t", s + 1, k), " "))
    held = F.flatten(F.transform("at", lambda i: F.flatten(F.transform(F.sequence(F.greatest(i - (most - 1), F.lit(0)), i), lambda s: grams(i, s)))))
    rows = at.select(F.explode(F.array_distinct(held)).alias("phrase")).filter(F.char_length("phrase").between(8, longest) & ~F.col("phrase").rlike("[0-9]"))
    rows = rows.filter(F.col("phrase").rlike(filler) & ~F.col("phrase").rlike(L.KNOWN_SLOP))
    return rows.groupBy("phrase").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)


def without_known(rows: DataFrame, known: DataFrame, chars: int = 80) -> DataFrame:
    """Rows whose prefix is not the prefix of a known text. Nulls as in NOT IN: a null text is in no known set and not outside one either."""
    key = F.left("text", F.lit(chars))
    seen = known.select(key.alias("_k")).distinct()
    size = seen.agg(F.count("*").alias("_n"), F.count_if(F.col("_k").isNull()).alias("_null"))  # one row
    out = rows.withColumn("_k", key).join(seen, "_k", "left_anti").join(F.broadcast(size))
    return out.filter((F.col("_n") == 0) | ((F.col("_null") == 0) & F.col("_k").isNotNull())).drop("_k", "_n", "_null")


def without_passages(rows: DataFrame, known: DataFrame, words: int = 10) -> DataFrame:
    """Rows that hold no run of `words` words of a known text, anywhere; of a shorter known text, no run of all its words. Null texts hold none."""
    from textloom.functions.text import tokens

    def runs(n):
        own = F.when((F.size("_t") >= n) & (n > 0), F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: F.array_join(F.slice("_t", i + 1, n), " ")))
        return F.explode(F.array_distinct(own))

    seen = known.select(tokens(F.col("text")).alias("_t")).withColumn("n", F.least(F.size("_t"), F.lit(words))).select("n", runs(F.col("n")).alias("run")).distinct()
    sizes = F.broadcast(seen.select("n").distinct())  # `words` rows at most
    docs = rows.select("doc_id", tokens(F.col("text")).alias("_t"))
    held = docs.join(sizes).select("doc_id", "n", runs(F.col("n")).alias("run")).join(seen, ["n", "run"], "left_semi").select("doc_id").distinct()
    return rows.join(held, "doc_id", "left_anti")


# Fixed values of the weak labels: results depend on exactly these patterns, which match without case.
SPECIFIC = [
    r"\b\d+(?:\.\d+)?\s*(?:ms|s|%|mb|gb|kb|rps|px|ns)\b", r"\b(?:CVE|PR|GH|RFC)-\d+", r"\b\w+\.\w{2,4}\b", r"(?:fixes?|closes?|resolves?)\s*#\d+",
    r"\bbecause\b|\bdue to\b|\bsince\b", r"\btradeoff\b|\balternative\b|\bconsidered\b", r"\b(?:p95|p99|p50)\b", r"\b\d{4,}\b", r"doi:\s*10\.\d{4}",
    r"\b(?:table|figure|equation)\s+\d+\b",
]
STOCK = [
    r"enhances?\s+(?:the\s+)?user\s+experience", r"robust\s+solution", r"various\s+(?:aspects?|issues?|improvements?)", r"comprehensive\s+(?:overview|guide|solution|update)",
    r"in\s+today'?s\s+(?:digital\s+)?(?:landscape|world)", r"seamless(?:ly)?\s+(?:integrat|experienc)", r"leverag(?:e|ing)\s+(?:existing|the|our)", r"going\s+forward",
    r"best\s+practices", r"it\s+is\s+(?:important|crucial|essential)\s+to\s+note", r"delve\s+(?:into|deeper)", r"game[- ]changer", r"cutting[- ]edge", r"paradigm\s+shift",
    r"unlock\s+the\s+(?:power|potential)",
]
ANSWER_DOMAINS = {
    "reddit": "social_news", "wiki": "content", "medicine": "academia", "finance": "content", "open_qa": "content", "closed_qa": "communications", "all": "content",
}
GENERATION_DOMAINS = {
    "news": "content", "reddit": "social_news", "recipes": "content", "abstracts": "academia", "reviews": "marketplace", "wiki": "content", "books": "content", "poetry": "content",
}
HUMAN, MACHINE = ["human", "reviewed"], ["ai", "chatgpt", "gpt", "gpt-4", "gpt-3.5", "claude", "llama", "mistral", "cohere", "davinci"]


def _shows(text: Column, patterns: list[str]) -> Column:
    return sum((text.rlike("(?iU)" + p).cast("int") for p in patterns), F.lit(0))


def weak_label(text: Column, least: int = 40) -> Column:
    """reviewed, slop or null: texts with specifics against texts with stock phrases; short ones and mixed ones are uncertain."""
    from textloom.functions.text import strip

    spec, slop = _shows(text, SPECIFIC), _shows(text, STOCK)
    return (
        F.when(F.char_length(strip(text)) < least, None).when(spec >= 3, "reviewed").when(slop >= 2, "slop").when((spec >= 2) & (slop == 0), "reviewed").when((slop >= 1) & (spec == 0), "slop")
    )


def abstract_label(text: Column) -> Column:
    """As weak_label(); an uncertain abstract is reviewed if it shows anything specific."""
    return F.coalesce(weak_label(text), F.when(_shows(text, SPECIFIC) >= 1, "reviewed").otherwise("slop"))


def answer_samples(answers: DataFrame, most: int = 2000, words: int = 30, chars: int = 1500) -> DataFrame:
    """(text, label, domain, source, id, pos) of rows (id, subset, human_answers, chatgpt_answers): answers of `words` words and more, cut to `chars`, at most `most` a subset and label by (id, pos)."""
    out = None
    for column, label in (("human_answers", "reviewed"), ("chatgpt_answers", "slop")):
        rows = answers.select("id", "subset", F.posexplode(column).alias("pos", "text")).withColumn("label", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    out = out.filter(F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")) >= words).withColumn("group", F.concat_ws("/", "subset", "label")).withColumn("at", F.struct("id", "pos"))
    out = cap_per_group(out, "group", "at", most)
    domain = F.coalesce(F.create_map(*(F.lit(x) for pair in ANSWER_DOMAINS.items() for x in pair))[F.col("subset")], F.lit("content"))
    return out.select(F.left("text", F.lit(chars)).alias("text"), "label", domain.alias("domain"), F.concat(F.lit("hc3_"), "subset").alias("source"), "id", "pos")


def generation_samples(rows: DataFrame, most: int = 3000, words: int = 20, chars: int = 1500) -> DataFrame:
    """(id, text, label, domain, source) of rows (id, generation, text, label, domain): of equal 80-character prefixes the smallest id, known labels only, the first `most` by id."""
    from textloom.functions.text import strip

    text = strip(F.coalesce(F.nullif("generation", F.lit("")), "text", F.lit("")))
    df = rows.select("id", text.alias("text"), F.lower(F.coalesce("label", F.lit(""))).alias("raw"), F.lower(F.coalesce("domain", F.lit(""))).alias("kind"))
    df = df.filter(F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")) >= words)
    first = df.groupBy(F.left("text", F.lit(80)).alias("prefix")).agg(F.min("id").alias("id")).select("id")
    label = F.when(F.col("raw").isin(HUMAN), "reviewed").when(F.col("raw").isin(MACHINE), "slop")
    df = df.join(first, "id", "left_semi").withColumn("label", label).filter(F.col("label").isNotNull())
    domain = F.coalesce(F.create_map(*(F.lit(x) for pair in GENERATION_DOMAINS.items() for x in pair))[F.col("kind")], F.lit("content"))
    return df.orderBy("id").limit(most).select("id", F.left("text", F.lit(chars)).alias("text"), "label", domain.alias("domain"), F.concat(F.lit("raid_"), "kind").alias("source"))


def merged(base: DataFrame, more: DataFrame, chars: int = 80) -> DataFrame:
    """base and those rows of more whose prefix neither base nor a smaller id of more has; both (id, text, ...)."""
    key = F.left(F.coalesce("text", F.lit("")), F.lit(chars))
    new = more.withColumn("_k", key).join(base.select(key.alias("_k")).distinct(), "_k", "left_anti")
    first = new.groupBy("_k").agg(F.min("id").alias("id"))
    return base.unionByName(new.join(first, ["_k", "id"], "left_semi").drop("_k"))
