"""Queries of the stance and domain signals and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import patterns as P
from textloom.operators import signals as S
from textloom.operators import stance as ST
from textloom.plans.queries import _CURVE, CORPUS, LATIN, _list, query, r4
from textloom.sources.readers import corpus

STANCE = f"(SELECT doc_id, concat_ws(' ', text, {_list(P.SAMPLES)}[doc_id % {len(P.SAMPLES)} + 1]) AS text FROM {CORPUS})"


def stance_corpus(spark, sf):
    sample = F.element_at(F.array(*map(F.lit, P.SAMPLES)), (F.col("doc_id") % len(P.SAMPLES) + 1).cast("int"))
    return corpus(spark, sf).select("doc_id", F.concat_ws(" ", "text", sample).alias("text"))


def _q(p: str) -> str:
    return p.replace("'", "''")


def _hits(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({c}, '(?i){_q(p)}') AS INTEGER)" for p in patterns) + ")"


def _count(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, '{_q(p)}'))"


def _present(c: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{_q(p)}') AS INTEGER)" for p in phrases) + ")"


_LENGTH = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
# letters beyond ASCII as a word character that no class of letters has
_MARKED = r"regexp_replace(text, '[^\P{L}\x00-\x7F]', '_', 'g')"
_PARTS = [
    ("0.15", _hits("text", P.EDITING), 5), ("0.12", _hits("text", P.REVISION), 4), ("0.10", _hits("text", P.UNCERTAINTY), 5), ("0.12", _hits("text", P.DISAGREEMENT), 5),
    ("0.08", _count("text", r"\?"), 5), ("0.04", f"({_count('text', '!')} + {_count('text', '[.][.][.]')})", 4), ("0.06", _count(LATIN, "(?i)" + P.CONTRACTION), 6),
    ("0.08", _count(LATIN, P.FIRST_PERSON), 8), ("0.13", _count(_MARKED, P.NAME_PAIR), 6), ("0.12", _count(LATIN, "(?i)" + P.DIRECT_REFERENCE), 4),
]


@query(f"SELECT doc_id, {r4(' + '.join(f'least({n}, {most}) * CAST({w} AS DOUBLE) / {most}' for w, n, most in _PARTS))} AS human_delta FROM {STANCE}")
def sig_human_delta(spark, sf):
    return stance_corpus(spark, sf).withColumn("low", F.lower("text")).select("doc_id", ST.human_delta(F.col("text"), F.col("low")).alias("human_delta"))


def _hedges(c: str) -> str:
    return rf"(len(list_intersect(list_distinct(list_transform(string_split_regex({c}, '\s+'), lambda w: trim(lower(w), '.,!?;:'))), {_list(P.HEDGE_WORDS)})) + {_hits(c, P.HEDGE_PHRASES)})"


@query(rf"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS i FROM {STANCE}),
h AS (SELECT doc_id, max({_hedges('p')}) AS cluster, arg_max({_hits('p', P.DEFLECTION)}, i) AS deflect FROM p WHERE regexp_matches(p, '\S') GROUP BY doc_id),
a AS (SELECT doc_id, {_LENGTH} AS size, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n, {_hedges('text')} AS hedges, {_hits('text', P.FALSE_BALANCE)} AS balance,
  {_hits('text', P.RESOLUTION)} > 0 AS res, {_hits('text', P.OPINION_LAUNDERING)} AS launder, {_hits('text', P.COMMITMENT)} AS commits,
  len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: list_contains({_list(P.TECHNICAL_WORDS)}, w))) AS technical FROM {STANCE}),
d AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE hedges / n * 100 END AS density FROM a LEFT JOIN h USING (doc_id)),
s AS (SELECT *, greatest(0e0, least(1e0, 0.5e0 - CASE WHEN technical >= 2 AND commits = 0 AND density < 2 THEN 0.15e0 ELSE 0 END
  - least(greatest(cluster - 2, 0) * 0.05e0, 0.25e0) - least(greatest(density - 3, 0) * 0.02e0, 0.20e0) - CASE WHEN balance > 0 AND NOT res THEN least(balance * 0.15e0, 0.30e0) ELSE 0 END
  - least(launder * 0.10e0, 0.25e0) - CASE WHEN deflect > 0 THEN 0.20e0 ELSE 0 END + least(commits * 0.08e0, 0.40e0) + CASE WHEN balance > 0 AND res THEN 0.10e0 ELSE 0 END)) AS score FROM d)
SELECT doc_id, {r4('density', 2)} AS hedge_density, CAST(cluster AS BIGINT) AS hedge_clustering, CASE WHEN size < 20 THEN 0.5 ELSE {r4('score')} END AS epistemic_cowardice, CASE WHEN size < 20 THEN 'insufficient_data' WHEN score >= 0.7 THEN 'committed'
WHEN score >= 0.5 THEN 'balanced' WHEN score >= 0.3 THEN 'hedged' ELSE 'cowardly' END AS stance_verdict FROM s""")  # fmt: skip
def sig_epistemic_cowardice(spark, sf):
    out = ST.commitment(stance_corpus(spark, sf).withColumn("_low", F.lower("text")))
    return out.select("doc_id", "hedge_density", F.col("hedge_clustering").cast("long").alias("hedge_clustering"), "epistemic_cowardice", "stance_verdict")


# no lookahead in this SQL: a claim counts as excused where any place of it is; a text here holds each claim once
_BARE = " + ".join(f"CAST(regexp_matches(text, '(?i){_q(c)}') AND NOT regexp_matches(text, '(?i){_q(c)}.{{0,100}}(?:{e})') AS INTEGER)" for c, e in P.BEST_PRACTICE)


@query(rf"""WITH a AS (SELECT doc_id, {_LENGTH} AS size, {_hits('text', P.REJECTED_ALTERNATIVES)} AS alt, {_hits('text', P.FAILURE_MODES)} AS fail, {_hits('text', P.SPECIFIC_CONDITIONS)} AS cond,
  {_hits('text', P.SPECIFIC_TRADEOFFS)} AS trade, {_hits('text', P.GENERIC_COUNTERFACTUALS)} AS gen, {_BARE} AS bare, {_present('lower(text)', P.COMPLEXITY)} >= 2
  AND {_present('lower(text)', P.NEGATIVE)} = 0 AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 80 AS rosy FROM {STANCE}),
s AS (SELECT *, greatest(0e0, least(1e0, least(alt * 0.15e0, 0.45e0) + least(fail * 0.12e0, 0.36e0) + least(cond * 0.10e0, 0.30e0) + least(trade * 0.12e0, 0.36e0) - least(gen * 0.08e0, 0.24e0)
  - least(bare * 0.10e0, 0.30e0) - CASE WHEN rosy AND alt + fail + cond + trade = 0 THEN 0.25e0 ELSE 0 END
  + CASE WHEN alt + fail + cond + trade > 0 AND (alt + fail + cond + trade) / (alt + fail + cond + trade + gen) >= 0.75 THEN 0.15e0 ELSE 0 END)) AS score FROM a)
SELECT doc_id, CASE WHEN size < 30 THEN 0.5 ELSE {r4('score')} END AS counterfactual_absence, CASE WHEN size < 30 THEN 'insufficient_data' WHEN score >= 0.7 THEN 'rich_counterfactuals' WHEN score >= 0.45 THEN 'some_counterfactuals'
WHEN score >= 0.25 THEN 'generic_counterfactuals' ELSE 'counterfactual_absence' END AS counterfactual_verdict FROM s""")  # fmt: skip
def sig_counterfactual_absence(spark, sf):
    return ST.counterfactuals(stance_corpus(spark, sf).withColumn("_low", F.lower("text"))).select("doc_id", "counterfactual_absence", "counterfactual_verdict")


@query(f"""WITH {_CURVE}, st AS (SELECT *, novelty - lag(novelty) OVER (PARTITION BY doc_id ORDER BY pos) AS step, min(novelty) OVER (PARTITION BY doc_id) AS lo,
  (max(novelty) OVER (PARTITION BY doc_id) - min(novelty) OVER (PARTITION BY doc_id)) / 5 AS width FROM c),
b AS (SELECT *, least(floor((novelty - lo) / nullif(width, 0)), 4) AS bin FROM st),
g AS (SELECT doc_id, count(*) AS n, {r4('var_pop(novelty)', 9)} AS v, {r4('coalesce(CASE WHEN count(*) > 1 THEN regr_slope(novelty, pos) END, 0)', 9)} AS sl, count(*) FILTER (WHERE step > 0.3) AS spikes, max(width) AS width,
  [{', '.join(f'count(*) FILTER (WHERE bin = {i})' for i in range(5))}] AS bins FROM b GROUP BY doc_id),
h AS (SELECT *, CASE WHEN width * 5 < 0.01 THEN 0 ELSE {r4('list_sum(list_transform(bins, lambda c: CASE WHEN c > 0 THEN -(c / n) * log2(c / n) ELSE 0 END))', 9)} END AS en FROM g),
r AS (SELECT doc_id, avg(CASE WHEN spread >= 3 THEN 1e0 ELSE 0e0 END) AS r FROM (SELECT doc_id, word, count(DISTINCT pos) AS spread FROM e GROUP BY ALL) GROUP BY doc_id),
fl AS (SELECT doc_id, {_present('lower(text)', P.CURVE_FILLER)} AS filler FROM {CORPUS}),
s AS (SELECT doc_id, n, greatest(0e0, least(1e0, CASE WHEN v > 0.08 THEN 0.30e0 WHEN v > 0.05 THEN 0.20e0 WHEN v > 0.03 THEN 0.10e0 ELSE 0 END
  + CASE WHEN sl < -0.01 THEN least(0.25e0, abs(sl) * 5) WHEN sl < 0 THEN 0.10e0 ELSE 0 END + least(spikes * 0.08e0, 0.25e0) + CASE WHEN en > 1.5 THEN 0.20e0 WHEN en > 1 THEN 0.12e0 WHEN en > 0.8 THEN 0.06e0 ELSE 0 END
  - least(coalesce(r, 0) * 1.5e0, 0.30e0) + greatest((0.10e0 - coalesce(r, 0)) * 2, 0) - least(filler * 0.06e0, 0.30e0))) AS score FROM h JOIN fl USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, CASE WHEN n < 6 THEN 0.5 ELSE {r4('score')} END AS vocabulary_novelty, CASE WHEN n < 6 THEN 'insufficient_data' WHEN score >= 0.65 THEN 'human_curve' WHEN score >= 0.4 THEN 'mixed_curve' WHEN score >= 0.2 THEN 'flat_curve' ELSE 'ai_curve' END AS curve_verdict FROM s""")
def sig_vocabulary_novelty(spark, sf):
    return ST.vocabulary_novelty(S.with_curve(S.text_features(corpus(spark, sf), ["doc_id"], ("sents", "_low")))).filter(F.size("curve") > 0).select("doc_id", "vocabulary_novelty", "curve_verdict")
