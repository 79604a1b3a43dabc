"""Does a text give reasons, and can they be checked? Claims, their specificity, and the signal made of them.

A claim is a sentence with a causal word; its reason is what follows the first connective. All of it is a row expression over
the sentences of a document, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import found as W
from textloom.functions import reasoning_patterns as P
from textloom.functions.lexicons import FILLER_PHRASES, KNOWN_SLOP
from textloom.functions.text import clamp, present, rounded, settled, strip, tokens
from textloom.operators.signals import mean

#: Unicode words, any case, only \n ends a line.
ANY = "(?iUd)"


def _has(c: Column, pattern: str, flags: str = ANY) -> Column:
    return c.rlike(flags + pattern)


def _times(c: Column, pattern: str, flags: str = ANY) -> Column:
    return F.regexp_count(c, F.lit(flags + pattern))


def _slop(c: Column) -> Column:
    return _times(c, KNOWN_SLOP.removeprefix("(?i)"))


def causal_clause(sentence: Column) -> Column:
    """(action, reasoning): what stands before and behind the first connective; without one the sentence, and an empty reasoning."""
    parts = F.split(sentence, ANY + P.CONNECTIVE, 2)
    there = F.size(parts) > 1
    return F.struct(F.when(there, strip(parts[0])).otherwise(sentence).alias("action"), F.when(there, strip(F.get(parts, F.lit(1)))).otherwise("").alias("reasoning"))


def markers(reason: Column) -> tuple[Column, Column, Column]:
    """How many kinds of high and of medium markers a reason has, and how many low ones."""
    count = lambda hits: sum((h.cast("int") for h in hits), F.lit(0))
    high = count([*(_has(reason, p) for p in P.HIGH.values()), _has(reason, P.FILE_PATH, "(?Ud)")])
    words = F.array_distinct(F.regexp_extract_all(F.lower(reason), F.lit(r"(?U)\w+"), F.lit(0)))
    tautology = F.lit(False)
    for p in P.TAUTOLOGIES:
        tautology = tautology | _has(reason, p)
    low = (
        tautology.cast("int") + sum((_times(reason, p) for p in [*P.LOW, P.HOLLOW]), F.lit(0)) + F.size(F.array_intersect(words, F.array(*map(F.lit, P.HEDGES))))
        + 2 * _slop(reason) + 2 * _has(reason, P.HEDGED_CAUSE).cast("int")
    )
    return high, count(_has(reason, p) for p in P.MEDIUM), low


def _identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-zA-Z_][a-zA-Z0-9_]{2,}"), F.lit(0)))


def codebase_boost(reason: Column, context: Column | None = None) -> Column:
    """0.08 for each identifier that reason and context share, 0.30 at most. None: the context is the text that the reason is from."""
    own = F.array_except(_identifiers(reason), F.array(*map(F.lit, P.COMMON_IDENTIFIERS)))
    return F.least(F.size(own if context is None else F.array_intersect(own, _identifiers(context))) * 0.08, F.lit(0.30))


def _graded(high: Column, medium: Column, low: Column, boost: Column) -> Column:
    base = (
        F.when(high >= 3, F.least(0.55 + high * 0.10, F.lit(0.85))).when(high == 2, 0.69).when(high == 1, 0.55)
        .when(medium >= 2, 0.50).when(medium == 1, 0.40).otherwise(0.12)
    )
    return rounded(F.least(F.greatest(base - F.least(low * 0.10, F.lit(0.4)), F.lit(0.0)) + boost, F.lit(1.0)), 3)


def specificity_of(reason: Column, boost: Column) -> Column:
    """0 to 1: can the reason be checked? 0.15 for fewer than two words."""
    return F.when(F.size(F.filter(F.split(reason, r"(?U)\s+"), lambda w: w != "")) < 2, 0.15).otherwise(_graded(*markers(reason), boost))


def threshold(domain: Column, which: int) -> Column:
    """The high bar (0) or the floor (1) of a domain; of "general" for any other."""
    table = F.create_map(*(F.lit(x) for d, values in P.THRESHOLDS.items() for x in (d, values[which])))
    return F.coalesce(table[F.coalesce(domain, F.lit("general"))], F.lit(P.THRESHOLDS["general"][which]))


def blended(confidence: Column, specificity: Column, domain: Column) -> Column:
    """Confidence that a claim gives a reason, less what it lacks in specifics; the floor of the domain stays."""
    floor = threshold(domain, 1)
    return rounded(confidence * (floor + (1 - floor) * specificity), 4)


def verdict(specificity: Column, domain: Column) -> Column:
    bar = threshold(domain, 0)
    return (
        F.when(specificity >= bar, "specific_reasoning").when(specificity >= bar * 0.5, "generic_reasoning").when(specificity >= 0.2, "qualitative_reasoning")
        .otherwise("unfalsifiable_reasoning")
    )


def suggestion(kind: Column, reason: Column) -> Column:
    measure = F.when(reason == "", P.SUGGEST_HOW).otherwise(F.concat(F.lit(P.SUGGEST_MEASUREMENT), F.left(reason, F.lit(60)), F.lit("? Under what conditions?")))
    return F.when(kind == "specific_reasoning", "").when(kind == "generic_reasoning", P.SUGGEST_SPECIFICS).when(kind == "qualitative_reasoning", P.SUGGEST_DETAILS).otherwise(measure)


def claim_array(sents: Column, domain: Column, context: Column | None = None, flags: Column | None = None) -> Column:
    """The claims among the sentences, as (pos, sentence, action, reasoning, why_confidence, specificity, blended, verdict, suggestion)."""
    if flags is None:
        numbered = F.filter(F.transform(sents, lambda s, i: F.struct(i.alias("pos"), s.alias("s"))), lambda x: _has(x["s"], P.CAUSAL))
    else:
        pairs = F.transform(F.zip_with(sents, flags, lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda x, i: F.struct(i.alias("pos"), x["s"].alias("s"), x["f"].alias("f")))
        numbered = F.filter(pairs, lambda x: W.flagged(x["f"], W.CAUSAL, _has(x["s"], P.CAUSAL)))
    cut = F.transform(numbered, lambda x: F.struct(
        x["pos"].alias("pos"), x["s"].alias("s"), causal_clause(x["s"]).alias("c"), F.least(0.75 + present(F.lower(x["s"]), P.WHY_MARKERS) * 0.1, F.lit(1.0)).alias("conf")))
    scored = F.transform(cut, lambda x: F.struct(
        x["pos"].alias("pos"), x["s"].alias("s"), x["c"].alias("c"), x["conf"].alias("conf"),
        F.when(x["c"]["reasoning"] == "", 0.25).otherwise(specificity_of(x["c"]["reasoning"], codebase_boost(x["c"]["reasoning"], context))).alias("spec")))
    return F.transform(scored, lambda x: F.struct(
        x["pos"].alias("pos"), x["s"].alias("sentence"), x["c"]["action"].alias("action"), x["c"]["reasoning"].alias("reasoning"), rounded(x["conf"], 3).alias("why_confidence"),
        x["spec"].alias("specificity"), blended(x["conf"], x["spec"], domain).alias("blended"), verdict(x["spec"], domain).alias("verdict"),
        suggestion(verdict(x["spec"], domain), x["c"]["reasoning"]).alias("suggestion")))


FLAGGED = ("unfalsifiable_reasoning", "generic_reasoning")


def claims(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, sentence, action, reasoning, why_confidence, specificity, blended, verdict, suggestion, flagged): one row per claim.

    docs has keys, sents, domain and perhaps context, a text whose identifiers make a claim more specific; without it they are
    those of the text itself. Documents without a claim have no row.
    """
    context = F.coalesce("context", F.lit("")) if "context" in docs.columns else None
    rows = settled(docs.select(*keys, claim_array(F.col("sents"), F.col("domain"), context).alias("claims"))).select(*keys, F.inline("claims"))
    return rows.withColumn("flagged", F.col("verdict").isin(*FLAGGED))


def why_vs_what(df: DataFrame) -> DataFrame:
    """Add why_vs_what, reasoning_specificity, reasoning_quality, flagged_claims and strong_claims to df (text, _low, sents, domain).

    Does the text give reasons, conditions, comparisons and evidence instead of saying only what was done? Reasons count by how far they can be checked.
    """
    n = F.greatest(F.size("sents"), F.lit(1))
    any_of = lambda name, patterns: W.told(df, name, sum((_has(F.col("text"), p).cast("int") for p in patterns), F.lit(0)))
    low, causal = F.col("_low"), F.size("_claims")
    df = settled(df.withColumn("_claims", claim_array(F.col("sents"), F.col("domain"), flags=F.col("_flags") if "_flags" in df.columns else None)))
    df = df.withColumn("reasoning_specificity", F.when(causal == 0, 0.5).otherwise(rounded(mean(F.transform("_claims", lambda c: c["blended"])), 4)))
    spec = F.col("reasoning_specificity")
    deep = F.size(F.filter("_claims", lambda c: (F.regexp_count(c["sentence"], F.lit(",")) >= 2) | c["sentence"].contains(";")))
    raw = (
        0.22 * spec + 0.17 * causal / n + 0.09 * F.size(F.filter("sents", lambda s: s.endswith("?"))) / n + 0.09 * F.least(any_of("conditional", P.CONDITIONAL) / 3.0, F.lit(1.0))
        + 0.09 * F.least(any_of("comparative", P.COMPARATIVE) / 3.0, F.lit(1.0)) + 0.09 * F.least(any_of("tradeoff", P.TRADEOFF) / 2.0, F.lit(1.0)) + 0.13 * deep / n
        + 0.12 * F.least(sum((W.told(df, k, _times(low, W.TIMES[k], "(?Ud)")) for k in ("before", "reduced")), F.lit(0)) / 2.0, F.lit(1.0))
    )
    quality = (
        F.when((causal == 0) & (present(low, P.WHY_MARKERS) == 0), "no_reasoning_detected").when(causal == 0, "insufficient_data")
        .when(spec >= 0.7, "specific").when(spec >= 0.45, "mixed").when(spec >= 0.3, "qualitative").otherwise("unfalsifiable")
    )
    listed = lambda keep, *names: F.transform(F.filter("_claims", keep), lambda c: F.struct(F.left(c["sentence"], F.lit(150)).alias("sentence"), *(c[x].alias(x) for x in names)))
    common = ("why_confidence", "specificity", "verdict")
    return df.withColumns(
        {
            "why_vs_what": rounded(clamp(raw), 4), "reasoning_quality": quality,
            "flagged_claims": listed(lambda c: c["verdict"].isin(*FLAGGED), *common, "suggestion"), "strong_claims": listed(lambda c: ~c["verdict"].isin(*FLAGGED), *common),
        }
    ).drop("_claims")


def slop_fingerprint(text: Column) -> Column:
    """(slop_score, total_signals, patterns_found, fake_specificity, hedged_causal): stock phrases, hollow specifics and hedged causes of a text."""
    found = [F.regexp_extract_all(text, F.lit(f"{ANY}({p})"), F.lit(1)) for p in (KNOWN_SLOP.removeprefix("(?i)"), P.HOLLOW, P.HEDGED_CAUSE)]
    a, b, c = map(F.size, found)
    return F.struct(
        rounded(F.least(a * 0.15 + b * 0.10 + c * 0.20, F.lit(1.0)), 3).alias("slop_score"), (a + b + c).alias("total_signals"),
        F.slice(found[0], 1, 10).alias("patterns_found"), F.slice(found[1], 1, 5).alias("fake_specificity"), F.slice(found[2], 1, 5).alias("hedged_causal"),
    )


def semantic_uniqueness(df: DataFrame) -> DataFrame:
    """Add semantic_uniqueness to df (_low and the part stats): distance of the letter triples from generated text, rare words, fresh word pairs, no filler.

    Only the triples of the fixed table are counted: all others add half their share to the divergence.
    """
    low = F.col("_low")
    n = F.greatest(F.char_length(low) - 2, F.lit(1))
    # a triple that begins and ends alike can overlap itself
    count = lambda t: F.regexp_count(low, F.lit(f"{t[:2]}(?={t[2]})")) if t[0] == t[-1] else (F.char_length(low) - F.char_length(F.replace(low, F.lit(t), F.lit("")))) / len(t)
    shares = F.array(*(F.struct((W.told(df, t, count(t)) / n).alias("p"), F.lit(q).alias("q")) for t, q in P.SLOP_TRIGRAMS.items() if len(t) == 3))
    never = sum(q for t, q in P.SLOP_TRIGRAMS.items() if len(t) != 3)
    df = settled(df.withColumn("_shares", shares))
    half = lambda x, m: 0.5 * x * F.log2(x / m)
    both = F.aggregate("_shares", F.lit(0.0), lambda a, x: a + F.when(x["p"] > 0, half(x["p"], (x["p"] + x["q"]) / 2) + half(x["q"], (x["p"] + x["q"]) / 2)).otherwise(0.5 * x["q"]))
    others = 1 - F.aggregate("_shares", F.lit(0.0), lambda a, x: a + x["p"])
    jsd = F.when(F.char_length(low) - 2 < 10, 0.5).otherwise(both + 0.5 * others + 0.5 * never)
    s = {c: F.col(c) for c in ("words", "hapax", "pairs")}
    raw = (
        0.45 * clamp(jsd / 0.6) + 0.25 * F.when(s["words"] < 5, 0.5).otherwise(s["hapax"] / s["words"]) + 0.20 * F.when(s["words"] < 3, 0.5).otherwise(s["pairs"] / (s["words"] - 1))
        - F.least(W.told(df, "filler", present(low, FILLER_PHRASES)) * 0.06, F.lit(0.35))
    )
    return df.withColumn("semantic_uniqueness", rounded(clamp(raw + 0.10), 4)).drop("_shares")


def circularity(df: DataFrame) -> DataFrame:
    """Add circular_pairs and circularity to df (sents): sentences two to four places apart of which the later has over half of the earlier one's words.

    References run from the first sentence of an entity to later ones, so they form no cycle, and such pairs alone lower the score of 1.
    """
    df = df.withColumn("_sets", F.transform("sents", lambda s: F.array_distinct(F.filter(tokens(s), lambda w: F.char_length(w) > 3))))
    m = F.size("sents")
    close = lambda a, b: (F.size(a) > 0) & (2 * F.size(F.array_intersect(a, b)) > F.size(a))
    pairs = lambda s, i: sum((F.coalesce(close(s, F.get("_sets", i + d)), F.lit(False)).cast("int") for d in (2, 3, 4)), F.lit(0))
    df = df.withColumn("circular_pairs", F.aggregate(F.transform("_sets", pairs), F.lit(0), lambda a, n: a + n))
    total = 3 * m - 9 + F.when(m == 3, 1).otherwise(0)
    score = rounded(1 - 0.3 * F.col("circular_pairs") / F.greatest(total, F.lit(1)), 3)
    return df.withColumn("circularity", F.when(m < 3, 1.0).otherwise(score)).drop("_sets")


def sentence_entities(sentence: Column) -> Column:
    """Words of four characters and more that may name something."""
    return F.array_except(F.regexp_extract_all(F.lower(sentence), F.lit(r"[a-z][a-z0-9_'-]{3,}"), F.lit(0)), F.array(*map(F.lit, P.NO_ENTITIES)))


def entity_edges(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst): from the sentence that first names an entity to each later one that names it."""
    rows = features.select(*keys, F.posexplode("sents").alias("dst", "s")).select(*keys, "dst", F.explode(sentence_entities(F.col("s"))).alias("entity"))
    first = rows.groupBy(*keys, "entity").agg(F.min("dst").alias("src"))
    return rows.join(first, [*keys, "entity"]).filter("src != dst").select(*keys, "src", "dst").distinct()
