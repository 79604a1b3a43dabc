"""Registered queries of the engine and the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.functions.found import with_found
from textloom.operators import analytics as A
from textloom.operators import datasets as D
from textloom.operators import scoring
from textloom.operators import signals as S
from textloom.operators import similarity as X
from textloom.operators import vector_index as V
from textloom.sources.readers import corpus, domain_of, host_domain, score_events, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


CUT = 48.0
EVENTS = "(SELECT event_id, ts, event_type AS domain, 'repo' || CAST(user_id % 20 AS VARCHAR) AS repo_id, CAST(user_id AS VARCHAR) AS author_id, value AS score FROM events)"
DOC_DOMAIN = f"{_list(L.DOMAINS)}[doc_id % {len(L.DOMAINS)} + 1]"
CORPUS = f"(SELECT doc_id, concat_ws(' ', text, {_list(L.SAMPLES)}[doc_id % {len(L.SAMPLES)} + 1]) AS text, {DOC_DOMAIN} AS domain, source AS repo_id, lang AS author_id FROM documents)"
SENTS = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
# word boundaries of this SQL know ASCII only
LATIN = r"regexp_replace(text, '[^\P{L}\x00-\x7F]', 'x', 'g')"
TOKS = "regexp_extract_all(lower({}), '[a-z][a-z0-9_''-]*')"


def r4(x: str, d: int = 4) -> str:
    return f"floor(({x}) * {10**d} + 0.500000001) / {10**d}"


def any_of(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


# ---- text primitives -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({TOKS.format('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOKS.format('text')})) AS BIGINT) AS n_distinct FROM {CORPUS}")
def tokenize_stats(spark, sf):
    t = T.tokens(F.col("text"))
    return corpus(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, CAST(len({SENTS}) AS BIGINT) AS n_sentences, CAST(list_max(list_transform({SENTS}, lambda s: length(s))) AS BIGINT) AS longest FROM {CORPUS}")
def sentence_stats(spark, sf):
    s = T.sentences(F.col("text"))
    return corpus(spark, sf).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, F.char_length)).cast("long").alias("longest"))


@query(f"SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, count(*) AS distinct_words, {r4('log2(sum(n)) - sum(n * log2(n)) / sum(n)')} AS entropy, {r4('count(*) FILTER (WHERE n = 1) / sum(n)')} AS hapax_ratio "
       f"FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({TOKS.format('text')}) AS word FROM {CORPUS}) GROUP BY ALL) GROUP BY doc_id")  # fmt: skip
def word_entropy(spark, sf):
    e = S.with_words(S.text_features(corpus(spark, sf), ["doc_id"], ("sents",)), "stats").filter("words > 0")
    return e.select("doc_id", F.col("words").cast("long").alias("words"), F.col("distinct").cast("long").alias("distinct_words"), T.rounded(F.col("entropy"), 4).alias("entropy"), T.rounded(F.col("hapax") / F.col("words"), 4).alias("hapax_ratio"))


@query("SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 3000) AS text FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html"), most=3000).alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_to_whole_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, CASE WHEN contains(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), 'blog') THEN 'content' ELSE 'general' END AS domain FROM pages")
def host_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))).alias("host"), host_domain(F.col("url")).alias("domain"))


@query(f"""WITH a AS (SELECT conv_id, turn, list_distinct(list_filter({TOKS.format('text')}, lambda w: length(w) > 3)) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE {r4('len(list_intersect(a.w, b.w)) / len(a.w)')} END AS overlap FROM a JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def overlap_previous_turn(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", T.rounded(T.overlap(F.col("text"), F.col("before")), 4).alias("overlap"))


# ---- signals ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN len(s) = 0 THEN 0.5 ELSE {r4(f'len(list_filter(s, lambda x: {any_of("x", L.CONCRETE)})) / len(s)')} END AS specificity FROM (SELECT doc_id, {SENTS} AS s FROM {CORPUS})")
def sig_specificity(spark, sf):
    f = with_found(S.text_features(corpus(spark, sf), ["doc_id"], ("sents",)), names=())
    return f.select("doc_id", S.specificity(F.col("sents"), F.col("_flags")).alias("specificity"))


_J = "(" + " OR ".join("contains(lower(x), '" + t + "')" for t in L.JARGON) + ")"


@query(f"""WITH s AS (SELECT doc_id, {SENTS} AS s FROM {CORPUS}), e AS (SELECT doc_id, unnest(s) AS x FROM s),
f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {_J}) AS j, count(*) FILTER (WHERE {any_of("x", L.EVIDENCE)}) AS e, count(*) FILTER (WHERE {_J} AND {any_of("x", L.EVIDENCE)}) AS je FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN n < 2 THEN 0.5 WHEN j = 0 THEN {r4('least(1.0, 0.55 + least(e * 0.08, 0.30))')} ELSE {r4('least(1.0, je / j * 0.8 + 0.15)')} END AS evidence_density FROM f""")
def sig_evidence_density(spark, sf):
    f = with_found(S.text_features(corpus(spark, sf), ["doc_id"], ("sents",)), names=())
    return f.select("doc_id", S.evidence_density(F.col("sents"), F.col("_flags")).alias("evidence_density"))


_OPENERS = f"list_transform(list_filter(list_transform(s, lambda x: {TOKS.format('x')}), lambda w: len(w) > 0), lambda w: CASE WHEN len(w) >= 3 THEN array_to_string(w[1:3], ' ') ELSE w[1] END)"
_FIRSTS = f"list_transform(list_filter(list_transform(s, lambda x: {TOKS.format('x')}), lambda w: len(w) > 0), lambda w: w[1])"
_CV = lambda v: f"coalesce(list_var_pop({v}) ** 0.5 / nullif(list_avg({v}), 0), 0)"


@query(rf"""WITH t AS (SELECT doc_id, text, lower(text) AS low, {SENTS} AS s FROM {CORPUS}),
f AS (SELECT *, list_transform(s, lambda x: CAST(len({TOKS.format('x')}) AS DOUBLE)) AS lengths, {_OPENERS} AS openers, {_FIRSTS} AS firsts,
  list_transform(s, lambda x: (length(x) - length(replace(x, ',', ''))) + 2.0e0 * (length(x) - length(replace(x, ';', ''))) + 1.5e0 * (length(x) - length(replace(x, '(', '')))) AS complexity,
  list_transform(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> ''), lambda p: CAST(length(p) AS DOUBLE)) AS paras,
  len(regexp_extract_all(text, '(?m)^\s*[-*•]\s')) + len(regexp_extract_all(text, '(?m)^\s*\d+[.)]\s')) AS lists, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
  len(regexp_extract_all({LATIN}, '(?i)\b(I|me|my|we|us|our|you|your)\b')) AS personal, len(regexp_extract_all({LATIN}, '(?i)\b(it is|there is|there are|one should|one can|this is)\b')) AS distant,
  {" + ".join(f"CAST(contains(lower(text), '{p}') AS INTEGER)" for p in L.TRANSITIONS)} AS transitions FROM t),
g AS (SELECT *, coalesce(list_max(list_transform(list_distinct(firsts), lambda w: len(list_filter(firsts, lambda v: v = w)))), 0) AS top FROM f)
SELECT doc_id, CASE WHEN len(s) < 3 THEN 0.5 ELSE {r4(f"""greatest(0e0, least(1e0, 0.20e0 * greatest(0, least(1, ({_CV('lengths')} - 0.1) / 0.6))
  + 0.10e0 * CASE WHEN len(paras) >= 3 THEN greatest(0, least(1, ({_CV('paras')} - 0.05) / 0.5)) ELSE 0.5 END + 0.15e0 * greatest(0, least(1, {_CV('complexity')} / 1.5))
  + 0.10e0 * least(1, coalesce(personal / nullif(personal + distant, 0), 0.5) * 1.2) - least((len(openers) - len(list_distinct(openers))) * 0.08, 0.40)
  - greatest(0, least(1, (top / greatest(len(s), 1) - 0.3) / 0.4)) * 0.15 - greatest(0, least(1, (lists / n_lines - 0.3) / 0.5)) * 0.15 - least(transitions * 0.06, 0.30) + 0.35e0))""")} END AS template_structure FROM g""")
def sig_template_structure(spark, sf):
    return S.template_structure(S.with_words(S.text_features(corpus(spark, sf), ["doc_id"], ("sents",)), "forms")).select("doc_id", "template_structure")


_STATS = f"""t AS (SELECT doc_id, text, {SENTS} AS s, {TOKS.format('text')} AS toks FROM {CORPUS}),
c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS word FROM t) GROUP BY ALL),
e AS (SELECT doc_id, sum(n) AS words, count(*) AS dist, count(*) FILTER (WHERE n = 1) AS hapax, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY doc_id),
p AS (SELECT doc_id, count(DISTINCT toks[i] || ' ' || toks[i + 1]) AS pairs FROM (SELECT doc_id, toks, unnest(range(1, len(toks))) AS i FROM t) GROUP BY doc_id)"""


@query(rf"""WITH {_STATS}, u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM t),
w AS (SELECT doc_id, pos, x, list_distinct({TOKS.format('x')}) AS ws FROM u),
k AS (SELECT doc_id, pos, x, ws, list_filter(ws, lambda v: length(v) > 4 AND NOT list_contains({_list(L.STOP_WORDS)}, v)) AS keys FROM w WHERE len(ws) >= 15),
z AS (SELECT k.doc_id, count(*) AS circular FROM k JOIN w o ON o.doc_id = k.doc_id AND o.x <> k.x WHERE len(k.keys) > 0 AND len(list_intersect(k.keys, o.ws)) / len(k.keys) > 0.5
  AND (len(o.ws) - len(list_intersect(o.ws, k.ws))) / greatest(len(o.ws), 1) < 0.3 GROUP BY k.doc_id),
x AS (SELECT doc_id, pos, unnest(ws) AS word FROM w), y AS (SELECT doc_id, word, min(pos) AS first FROM x GROUP BY ALL),
v AS (SELECT doc_id, avg(share) AS novelty FROM (SELECT x.doc_id, x.pos, count(*) FILTER (WHERE first = pos) / count(*) AS share FROM x JOIN y USING (doc_id, word) GROUP BY ALL) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN coalesce(words, 0) < 3 THEN 0.5 ELSE {r4(f"""greatest(0e0, least(1e0, 0.15e0 * (1 - len(list_filter(toks, lambda q: list_contains({_list(L.STOP_WORDS)}, q))) / words) + 0.20e0 * least(1, entropy / log2(words)) + 0.15e0 * pairs / (words - 1)
  + 0.15e0 * CASE WHEN len(s) >= 2 THEN coalesce(novelty, 0.5) ELSE 0.5 END + 0.10e0 * greatest(0, least(1, (list_sum(list_transform(toks, lambda q: length(q))) / words - 3.0) / 4.0)) + 0.15e0 * dist / words
  + least(({" + ".join(f"len(regexp_extract_all(text, '{q}'))" for q in L.CONCRETE)}) * 0.015e0, 0.15) - least(({" + ".join(f"CAST(contains(lower(text), '{q.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for q in L.FILLER_PHRASES)}) * 0.05e0, 0.30)
  - least(coalesce(circular, 0) * 0.10e0, 0.40) + 0.05e0))""")} END AS information_density FROM t LEFT JOIN e USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN z USING (doc_id)""")
def sig_information_density(spark, sf):
    names = ["filler", *(f"concrete{i}" for i in range(len(L.CONCRETE)))]
    f = with_found(S.text_features(corpus(spark, sf), ["doc_id"], ("sents", "_low")), names, False, ("stats", "circular", "fresh"))
    return S.information_density(f).select("doc_id", "information_density")


#: Letters beyond ASCII become a capital, which no class of the curve's words has: word boundaries of this SQL know ASCII only.
_CURVE = rf"""w AS (SELECT doc_id, pos, list_filter(regexp_extract_all(regexp_replace(lower(x), '[^\P{{L}}\x00-\x7F]', 'X', 'g'), '\b[a-z][a-z0-9_-]*\b'), lambda w: length(w) > 2 AND NOT list_contains({_list(L.CURVE_STOP_WORDS)}, w)) AS ws
  FROM (SELECT doc_id, unnest({SENTS}) AS x, generate_subscripts({SENTS}, 1) - 1 AS pos FROM {CORPUS})),
e AS (SELECT doc_id, pos, unnest(ws) AS word FROM w), f AS (SELECT doc_id, word, min(pos) AS first FROM e GROUP BY ALL),
n AS (SELECT e.doc_id, e.pos, count(*) FILTER (WHERE first = e.pos) / count(*) AS novelty FROM e JOIN f ON f.doc_id = e.doc_id AND f.word = e.word GROUP BY ALL),
c AS (SELECT w.doc_id, w.pos, coalesce(novelty, 0.0) AS novelty FROM w LEFT JOIN n ON n.doc_id = w.doc_id AND n.pos = w.pos)"""


@query(f"WITH {_CURVE} SELECT doc_id, CAST(pos AS BIGINT) AS pos, {r4('novelty')} AS novelty FROM c")
def novelty_curve(spark, sf):
    c = S.with_curve(S.text_features(corpus(spark, sf), ["doc_id"], ("sents",))).select("doc_id", F.posexplode("curve").alias("pos", "novelty"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), T.rounded(F.col("novelty"), 4).alias("novelty"))


@query(f"""WITH {_CURVE} SELECT doc_id, count(*) AS sentences, {r4('var_pop(novelty)')} AS variance, CAST(count(*) FILTER (WHERE step > 0.3) AS BIGINT) AS spikes, false AS front_loading
FROM (SELECT *, novelty - lag(novelty) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM c) GROUP BY doc_id""")
def novelty_shape(spark, sf):
    s = S.with_curve(S.text_features(corpus(spark, sf), ["doc_id"], ("sents",))).filter(F.size("curve") > 0)
    return s.select("doc_id", F.size("curve").cast("long").alias("sentences"), T.rounded(S.variance(F.col("curve")), 4).alias("variance"), S.spikes("curve").cast("long").alias("spikes"), S.front_loading().alias("front_loading"))


@query()
def score_documents(spark, sf):
    return scoring.score_documents(corpus(spark, sf), ["doc_id", "domain"])


@query()
def oversight_counts(spark, sf):
    return score_documents(spark, sf).groupBy("domain", "oversight").agg(F.count("*").alias("n"), T.rounded(F.avg("score"), 2).alias("avg_score"))


# ---- baselines and analytics -----------------------------------------------------------------------------------------


@query(f"""SELECT CASE WHEN g = 3 THEN 'global' WHEN g = 1 THEN 'repo' ELSE 'author' END AS grain, domain, repo_id, author_id, n, {r4('mean')} AS mean, {r4('std')} AS std, low, high
FROM (SELECT domain, repo_id, author_id, grouping(domain, repo_id, author_id) AS g, count(*) AS n, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std, min(score) AS low, max(score) AS high
FROM {EVENTS} GROUP BY GROUPING SETS ((domain), (repo_id, domain), (author_id, repo_id, domain)))""")
def baseline_grouping_sets(spark, sf):
    b = A.baselines(score_events(spark, sf))
    return b.withColumns({"mean": T.rounded(F.col("mean"), 4), "std": T.rounded(F.col("std"), 4)})


_CDF = "CASE WHEN s > 0 THEN CAST(floor((CASE WHEN z >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END) * 100 + 0.5) AS INTEGER) END"


def _pct(m: str, s: str) -> str:
    z = f"((score - {m}) / nullif({s}, 0))"
    t = f"(1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0))))"
    erf = f"(1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-(abs({z}) / sqrt(2.0)) * (abs({z}) / sqrt(2.0))))"
    return f"CASE WHEN {s} > 0 THEN CAST(floor((CASE WHEN {z} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END) * 100 + 0.5) AS INTEGER) END"


@query(f"""WITH e AS (SELECT * FROM {EVENTS}), r AS (SELECT domain, repo_id, avg(score) AS rm, coalesce(stddev_samp(score), 0) AS rs, count(*) AS rn FROM e GROUP BY ALL),
g AS (SELECT domain, avg(score) AS gm, coalesce(stddev_samp(score), 0) AS gs, count(*) AS gn FROM e GROUP BY ALL)
SELECT event_id, score, {r4('rm')} AS repo_mean, {_pct('rm', 'rs')} AS repo_percentile, {r4('gm')} AS global_mean, {_pct('gm', 'gs')} AS global_percentile,
CASE WHEN score > rm + rs THEN 'above_repo' WHEN score < rm - rs THEN 'below_repo' WHEN score > gm + gs THEN 'above_global' WHEN score < gm - gs THEN 'below_global' ELSE 'typical' END AS verdict,
CASE WHEN greatest(rn, gn) >= 20 THEN 'high' WHEN greatest(rn, gn) >= 5 THEN 'medium' WHEN greatest(rn, gn) >= 2 THEN 'low' ELSE 'none' END AS confidence
FROM e JOIN r USING (domain, repo_id) JOIN g USING (domain)""")
def relative_score(spark, sf):
    return A.relative_scores(score_events(spark, sf))


@query(f"""SELECT event_id, domain, score, seen, {r4('m + 1e-9')} AS running_mean, score < m - 1e-9 AS is_slop FROM (SELECT *, count(*) OVER w AS seen, avg(score) OVER w AS m FROM {EVENTS}
WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def running_baseline(spark, sf):
    return A.running_baseline(score_events(spark, sf))


def _board(key: str) -> str:
    return f"SELECT {key}, count(*) AS n, {r4('avg(score)')} AS avg_score, count(*) FILTER (WHERE score < {CUT}) AS slop_count, {r4(f'100.0 * count(*) FILTER (WHERE score < {CUT}) / count(*)', 2)} AS slop_pct FROM {EVENTS} GROUP BY ALL"


@query(_board("domain"))
def domain_leaderboard(spark, sf):
    return A.leaderboard(score_events(spark, sf), "domain", CUT)


@query(_board("repo_id"))
def source_leaderboard(spark, sf):
    return A.leaderboard(score_events(spark, sf), "repo_id", CUT)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS rn FROM {EVENTS}), n AS (SELECT *, count(*) OVER (PARTITION BY repo_id) AS n FROM r WHERE rn <= 5000)
SELECT repo_id, max(n) AS n, {r4('avg(score)')} AS avg_score, {r4('coalesce(avg(score) FILTER (WHERE rn <= floor(n / 4)) - avg(score) FILTER (WHERE rn > floor(n / 4)), 0)')} AS trend FROM n GROUP BY repo_id""")
def site_leaderboard(spark, sf):
    return A.trend(score_events(spark, sf), "repo_id")


@query(f"SELECT date_trunc('minute', ts) AS bucket, count(*) AS n, {r4('avg(score)')} AS avg_score FROM {EVENTS} GROUP BY 1")
def minute_history(spark, sf):
    return A.minute_history(score_events(spark, sf))


@query(f"""SELECT domain, bucket, n, {r4('mean')} AS mean, {r4('coalesce(lag(mean) OVER (PARTITION BY domain ORDER BY bucket) - mean, 0)')} AS delta
FROM (SELECT domain, date_trunc('hour', ts) AS bucket, count(*) AS n, avg(score) AS mean FROM {EVENTS} GROUP BY ALL)""")
def ticker_windows(spark, sf):
    return A.ticker(score_events(spark, sf))


@query(f"SELECT domain, n, {r4('100 * n / sum(n) OVER ()', 2)} AS pct FROM (SELECT domain, count(*) AS n FROM {EVENTS} GROUP BY ALL)")
def trending_signals_view(spark, sf):
    return A.share_of_total(score_events(spark, sf), "domain")


@query(f"""SELECT repo_id, week, n, {r4('mean')} AS mean, {r4('coalesce(mean - lag(mean) OVER (PARTITION BY repo_id ORDER BY week), 0)')} AS change
FROM (SELECT repo_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n, avg(score) AS mean FROM {EVENTS} GROUP BY ALL)""")
def slop_velocity(spark, sf):
    return A.slop_velocity(score_events(spark, sf))


@query(f"SELECT event_id, domain, score FROM {EVENTS} ORDER BY score, event_id LIMIT 50")
def worst_items(spark, sf):
    return A.worst(score_events(spark, sf), 50).select("event_id", "domain", "score")


@query(f"SELECT event_id, domain, score FROM (SELECT * FROM {EVENTS} ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE domain = 'error'")
def feed_filter_after_limit(spark, sf):
    return A.latest(score_events(spark, sf), 100).filter("domain = 'error'").select("event_id", "domain", "score")


_Q = "(SELECT d.doc_id, " + DOC_DOMAIN.replace("doc_id", "d.doc_id") + " AS domain, l.quality, CAST(d.n_chars % 100 AS DOUBLE) AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _judged(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", domain_of(F.col("doc_id")).alias("domain"), "quality", (F.col("n_chars") % 100).cast("double").alias("score"))


@query(f"""SELECT domain, tp, tn, fp, fn, {r4('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r4('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {r4('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1,
{r4('coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)')} AS accuracy, {r4('coalesce(reviewed - slop, 0)')} AS gap FROM (SELECT domain, count(*) FILTER (WHERE score < 48 AND quality = 0) AS tp,
count(*) FILTER (WHERE score >= 48 AND quality = 1) AS tn, count(*) FILTER (WHERE score < 48 AND quality = 1) AS fp, count(*) FILTER (WHERE score >= 48 AND quality = 0) AS fn,
avg(score) FILTER (WHERE quality = 0) AS slop, avg(score) FILTER (WHERE quality = 1) AS reviewed FROM {_Q} GROUP BY ROLLUP (domain))""")
def confusion_matrix_rollup(spark, sf):
    return A.confusion(_judged(spark, sf), CUT)


_HOOKS = [(1, "score_below", 5.0, ["error", "view"]), (2, "score_above", 200.0, []), (3, "oversight_change", 0.0, [])]


@query(f"SELECT event_id, CAST(1 AS BIGINT) AS hook_id FROM {EVENTS} WHERE domain IN ('error', 'view') AND score < 5 UNION ALL SELECT event_id, CAST(2 AS BIGINT) FROM {EVENTS} WHERE score > 200")
def webhook_matches(spark, sf):
    e = score_events(spark, sf)
    hooks = spark.createDataFrame(_HOOKS, "hook_id long, trigger string, threshold double, domains array<string>")
    every = e.select("domain").distinct().agg(F.collect_set("domain").alias("every"))
    hooks = hooks.join(F.broadcast(every)).withColumn("domains", F.when(F.size("domains") == 0, F.col("every")).otherwise(F.col("domains")))  # one row
    return A.webhook_matches(e, F.broadcast(hooks))


@query(f"""SELECT domain, list_reduce(list_prepend(4800e0, list(step ORDER BY ts, event_id)), lambda a, s: greatest(3000e0, least(7000e0, a + s))) / 100 AS threshold FROM (
  SELECT domain, ts, event_id, floor(CASE WHEN score < {CUT} THEN -1 ELSE 1 END * least(2e0, 2 * least(1e0, score / 100)) * 0.05e0 * 100 + 0.5e0) AS step FROM {EVENTS}) GROUP BY domain""")
def threshold_fold(spark, sf):
    e = score_events(spark, sf).select("domain", "ts", F.col("event_id").alias("id"), (F.col("score") < CUT).alias("was_too_harsh"), F.least(F.lit(1.0), F.col("score") / 100).alias("confidence"))
    return A.adapt_thresholds(e)


# ---- similarity and datasets -----------------------------------------------------------------------------------------


@query(f"""SELECT fingerprint, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, array_to_string(list_transform({SENTS}[1:8], lambda s: least(20, len({TOKS.format('s')}))), ',') AS fingerprint FROM {CORPUS}) GROUP BY 1 HAVING count(*) > 1""")
def fingerprint_clusters(spark, sf):
    return X.fingerprint_clusters(corpus(spark, sf))


@query(f"SELECT opening, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, array_to_string({TOKS.format('text')}[1:5], ' ') AS opening FROM {CORPUS}) WHERE opening <> '' GROUP BY 1 HAVING count(*) > 1")
def opening_clusters(spark, sf):
    return X.opening_clusters(corpus(spark, sf))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS sim FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def vector_topk(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return V.search(v, v.filter("vec_id % 20 = 0"), 15)


@query("""WITH s AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id < 4), c AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(CAST(x AS DOUBLE)) AS x FROM s GROUP BY i))
SELECT vec_id, floor(greatest(0e0, least(1e0, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), c))) * 1e5 + 0.5) / 1e5 AS uniqueness FROM embeddings, c""")
def centroid_uniqueness(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return X.centroid_uniqueness(v, v.filter("vec_id < 4"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(coalesce(text, ''), 80)")
def dedup_prefix(spark, sf):
    return D.dedup_prefix(table(spark, sf, "documents"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def cap_per_group(spark, sf):
    return D.cap_per_group(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query(f"""SELECT doc_id, domain, quality FROM (SELECT *, count(*) FILTER (WHERE quality = 0) OVER (PARTITION BY domain) AS slop, row_number() OVER (PARTITION BY domain, quality ORDER BY doc_id) AS rank FROM {_Q})
WHERE quality = 0 OR rank <= greatest(3 * slop, 10)""")
def balance_classes(spark, sf):
    return D.balance(_judged(spark, sf))


@query(f"""SELECT phrase, count(*) AS docs FROM (SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS phrase FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT doc_id, {TOKS.format('text')} AS t FROM {CORPUS})))
WHERE length(phrase) BETWEEN 8 AND 60 AND NOT regexp_matches(phrase, '[0-9]') GROUP BY 1 HAVING count(*) >= 3""")
def pattern_mining(spark, sf):
    return D.phrase_counts(corpus(spark, sf), 3, 3)


_FILLED = " OR ".join(f"contains(p, '{w}')" for w in L.FILLER)
_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, unnest(list_distinct(list_filter(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' ')), lambda p: length(p) BETWEEN 8 AND 60 AND ({_FILLED})))) AS phrase FROM toks" for n in range(2, 7)
)


# phrases are made inside a document's row: a row for each place with a copy of the whole document would not fit a long one
@query(f"""WITH toks AS (SELECT doc_id, {TOKS.format('text')} AS t FROM {CORPUS}), p AS ({_PHRASES})
SELECT phrase, count(DISTINCT doc_id) AS docs FROM p WHERE NOT regexp_matches(phrase, '[0-9]') AND NOT regexp_matches(phrase, '{L.KNOWN_SLOP.replace("'", "''")}') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def pattern_mining_filler(spark, sf):
    return D.filler_phrases(corpus(spark, sf), 3)


@query("SELECT doc_id FROM documents WHERE left(text, 80) NOT IN (SELECT left(text, 80) FROM benchmark)")
def known_phrase_antijoin(spark, sf):
    return D.without_known(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id")


_RUNS = "(SELECT {id}, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS run FROM {rows})"


@query(f"""WITH k AS (SELECT item_id, t, least(len(t), 10) AS n FROM (SELECT item_id, {TOKS.format('text')} AS t FROM benchmark) WHERE len(t) > 0), r AS (SELECT DISTINCT n, run FROM {_RUNS.format(id="item_id", rows="k")}),
d AS (SELECT doc_id, t, n FROM (SELECT doc_id, {TOKS.format('text')} AS t FROM documents), (SELECT DISTINCT n FROM r) WHERE len(t) >= n)
SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT doc_id AS hit FROM {_RUNS.format(id="doc_id", rows="d")} JOIN r USING (n, run)) WHERE hit = doc_id)""")
def known_passage_antijoin(spark, sf):
    return D.without_passages(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")).select("doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversight_counts(spark, sf_dir)
