"""Signals of a document, from its text alone. Each is a row expression over its sentences, whose words are counted in Arrow batches
(functions/wordstats.py), so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import found as W
from textloom.functions import lexicons as L
from textloom.functions.text import all_matches, any_match, clamp, paragraphs, present, rounded, sentences, settled, spread, tokens


def text_features(docs: DataFrame, keys: list[str], parts: tuple[str, ...] = ("sents", "toks", "sent_toks", "_low")) -> DataFrame:
    """keys, text and those parts of it (and domain, if docs has one): computed once and shared by all signals. A part that is not read is not left out by the optimizer."""
    more = [c for c in ("domain", "context", "diff", "comments") if c in docs.columns and c not in keys]
    df = spread(docs).select(*keys, *more, F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({k: f(F.col("text")) for k, f in {"sents": sentences, "toks": tokens}.items() if k in parts})
    more = {"sent_toks": lambda: F.transform("sents", tokens), "_low": lambda: F.lower("text")}
    return settled(df.withColumns({k: f() for k, f in more.items() if k in parts}))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))


def variance(values: Column) -> Column:
    """Population variance."""
    m = mean(values)
    return F.greatest(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(F.size(values), F.lit(1)) - m * m, F.lit(0.0))


def variation(values: Column) -> Column:
    """Population standard deviation over mean; 0 where the mean is 0."""
    m = mean(values)
    return F.when(m > 0, F.sqrt(variance(values)) / m).otherwise(0.0)


def with_words(df: DataFrame, *parts: str) -> DataFrame:
    """Add the columns of those parts of wordstats.PARTS to df (sents)."""
    return W.with_found(df, (), False, parts)


def specificity(sents: Column, flags: Column | None = None) -> Column:
    flags = F.transform(sents, lambda s: F.lit(None).cast("int")) if flags is None else flags
    hits = F.size(F.filter(F.zip_with(sents, flags, lambda s, f: W.flagged(f, W.CONCRETE, any_match(s, L.CONCRETE))), lambda x: x))
    return F.when(F.size(sents) == 0, 0.5).otherwise(rounded(hits / F.size(sents), 4))


def evidence_density(sents: Column, known: Column | None = None) -> Column:
    """Share of sentences with jargon that have evidence too. A sentence is lower-cased once, and the flags are counted in one pass: a column that is read more than once would be computed as often."""
    with_digit, without = [p for p in L.EVIDENCE if r"\d" in p], [p for p in L.EVIDENCE if r"\d" not in p]
    measured = lambda s, low: any_match(low, ["show|indicate|reveal|measur"]) & any_match(s, without)  # noqa: E731 - what the one pattern without a number ends with
    flag = lambda s, low: F.struct(reduce(or_, map(low.contains, L.JARGON)).alias("j"), ((s.rlike(r"\d") & any_match(s, with_digit)) | measured(s, low)).alias("e"))
    if known is None:
        flags = F.zip_with(sents, F.transform(sents, lambda s: F.lower(s)), flag)
    else:
        told = F.zip_with(sents, known, lambda s, f: F.struct(s.alias("s"), f.alias("f"), F.when(f.isNull(), F.lower(s)).alias("low")))
        bit = lambda f, b: f.bitwiseAND(F.lit(b)) != 0
        flags = F.transform(told, lambda x: F.when(x["f"].isNull(), flag(x["s"], x["low"])).otherwise(F.struct(bit(x["f"], W.JARGON).alias("j"), bit(x["f"], W.EVIDENCE).alias("e"))))
    n = lambda c: c.cast("int")
    counts = F.aggregate(
        flags, F.struct(*(F.lit(0).alias(c) for c in ("all", "j", "e", "both"))),
        lambda a, x: F.struct((a["all"] + 1).alias("all"), (a["j"] + n(x["j"])).alias("j"), (a["e"] + n(x["e"])).alias("e"), (a["both"] + n(x["j"] & x["e"])).alias("both")),
    )

    def score(c: Column) -> Column:
        none = 0.55 + F.least(c["e"] * 0.08, F.lit(0.30))
        backed = c["both"] / F.greatest(c["j"], F.lit(1)) * 0.8 + 0.15
        return F.when(c["all"] < 2, 0.5).otherwise(rounded(clamp(F.when(c["j"] == 0, none).otherwise(backed)), 4))

    return F.get(F.transform(F.array(counts), score), F.lit(0))


def template_structure(df: DataFrame) -> DataFrame:
    """Add template_structure to df (text, sents and their forms): uniform lengths, repeated openings, lists and transitions lower it."""
    df = df.withColumn("_paras", F.transform(paragraphs(F.col("text")), lambda p: F.char_length(p).cast("double")))
    text, low = F.col("text"), F.lower("text")
    lists = F.regexp_count(text, F.lit(r"(?m)^\s*[-*•]\s")) + F.regexp_count(text, F.lit(r"(?m)^\s*\d+[.)]\s"))
    personal, distant = (W.told(df, k, F.regexp_count(text, F.lit(f"(?iU){W.TIMES[k]}"))) for k in ("personal", "distant"))
    voice = F.when(personal + distant > 0, personal / (personal + distant)).otherwise(0.5)
    raw = (
        0.20 * clamp((F.col("length_varies") - 0.1) / 0.6)
        + 0.10 * F.when(F.size("_paras") >= 3, clamp((variation(F.col("_paras")) - 0.05) / 0.5)).otherwise(0.5)
        + 0.15 * clamp(F.col("complexity_varies") / 1.5)
        + 0.10 * clamp(voice * 1.2)
        - F.least(F.col("openers_again") * 0.08, F.lit(0.40))
        - clamp((F.col("first_most") / F.greatest(F.size("sents"), F.lit(1)) - 0.3) / 0.4) * 0.15
        - clamp((lists / (F.regexp_count(text, F.lit("\n")) + 1) - 0.3) / 0.5) * 0.15
        - F.least(W.told(df, "transitions", present(low, L.TRANSITIONS)) * 0.06, F.lit(0.30))
    )
    out = df.withColumn("template_structure", F.when(F.size("sents") < 3, 0.5).otherwise(rounded(clamp(raw + 0.35), 4)))
    return out.drop("_paras")


def with_curve(df: DataFrame) -> DataFrame:
    """Add curve, the share of each sentence's content words that no earlier sentence has, and curve_wide, the share of words in three or more sentences, to df (sents)."""
    return with_words(df, "curve")


def slope(values: Column) -> Column:
    """Of the regression line through the values; 0 for fewer than two."""
    n = F.size(values)
    xy = F.aggregate(F.transform(values, lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x)
    x, xx = n * (n - 1) / 2, (n - 1).cast("double") * n * (2 * n - 1) / 6
    return F.when(n < 2, 0.0).otherwise((n * xy - x * mean(values) * n) / (n * xx - x * x))


def spikes(curve: str) -> Column:
    """Steps of more than 0.3 to the next value."""
    return F.size(F.filter(F.transform(curve, lambda v, i: v - F.get(curve, i - 1)), lambda d: d > 0.3))


def front_loading() -> Column:
    """Whether terms are front-loaded: never, as the first quarter ends where the middle begins, and the two may not touch."""
    return F.lit(False)


def binned_entropy(curve: str, low: str, width: str) -> Column:
    """Bits of the values in five bins of that width from the lowest value; 0 where they hardly differ."""
    frame = F.array_repeat(F.struct(F.col(low).alias("low"), F.col(width).alias("width")), F.size(curve))
    bins = F.zip_with(curve, frame, lambda v, x: F.least(F.floor((v - x["low"]) / x["width"]), F.lit(4)))
    count = lambda k: F.size(F.filter(bins, lambda x: x == k))
    counts = F.array(*map(count, range(5)))
    return F.when(F.col(width) * 5 < 0.01, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / F.size(curve) * F.log2(c / F.size(curve))).otherwise(0.0)))


def information_density(df: DataFrame) -> DataFrame:
    """Add information_density to df (text, _low, sents, and the parts stats, circular and fresh): few stop words, fresh words and pairs, long words, no filler, nothing said twice."""
    n = F.col("words")
    raw = (
        0.15 * (1 - F.col("stop") / n)
        + 0.20 * clamp(F.col("entropy") / F.log2(n))
        + 0.15 * F.col("pairs") / (n - 1)
        + 0.15 * F.when(F.size("sents") >= 2, F.coalesce("fresh", F.lit(0.5))).otherwise(0.5)
        + 0.10 * clamp((F.col("letters") / n - 3.0) / 4.0)
        + 0.15 * F.col("distinct") / n
        + F.least(sum((W.told(df, f"concrete{i}", all_matches(F.col("text"), [p])) for i, p in enumerate(L.CONCRETE)), F.lit(0)) * 0.015, F.lit(0.15))
        - F.least(W.told(df, "filler", present(F.col("_low"), L.FILLER_PHRASES)) * 0.05, F.lit(0.30))
        - F.least(F.col("circular") * 0.10, F.lit(0.40))
    )
    return df.withColumn("information_density", F.when(n < 3, 0.5).otherwise(rounded(clamp(raw + 0.05), 4)))
