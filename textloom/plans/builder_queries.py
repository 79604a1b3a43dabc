"""Queries of further aggregates, dataset builders and sources of markup, and the SQL that checks them."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import analytics as A
from textloom.operators import datasets as D
from textloom.operators import scoring
from textloom.plans.domain_queries import _array, _pick
from textloom.plans.queries import CORPUS, EVENTS, _list, query, r4
from textloom.plans.stance_queries import _q
from textloom.sources import markup as M
from textloom.sources import sinks
from textloom.sources.readers import corpus, score_events, table

# ---- aggregates --------------------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT repo_id, domain, author_id, count(*) AS n, {r4('avg(score)', 1)} AS mean FROM {EVENTS} GROUP BY ALL),
l AS (SELECT repo_id, domain, string_agg(author_id || ':' || CAST(n AS VARCHAR) || ':' || CAST(CAST(mean * 10 AS BIGINT) AS VARCHAR), ',' ORDER BY n DESC, author_id) AS authors FROM a GROUP BY ALL)
SELECT repo_id, domain, count(*) AS sample_count, {r4('avg(score)', 1)} AS mean_score, {r4('coalesce(stddev_samp(score), 0)', 2)} AS std_dev, {r4('min(score)', 1)} AS min_score, {r4('max(score)', 1)} AS max_score, max(authors) AS authors
FROM {EVENTS} JOIN l USING (repo_id, domain) GROUP BY repo_id, domain""")
def repo_profiles(spark, sf):
    shown = F.transform("authors", lambda a: F.concat_ws(":", a["author_id"], a["sample_count"].cast("string"), F.round(a["mean_score"] * 10).cast("long").cast("string")))
    return A.repo_profiles(score_events(spark, sf)).withColumn("authors", F.array_join(shown, ","))


@query(f"""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY ts DESC, event_id DESC) AS rn FROM {EVENTS}) WHERE rn <= 50),
d AS (SELECT author_id, domain, {r4('sum(score) / count(*)', 1)} AS mean FROM n GROUP BY ALL), s AS (SELECT author_id, string_agg(domain || ':' || CAST(CAST(mean * 10 AS BIGINT) AS VARCHAR), ',' ORDER BY domain) AS domains FROM d GROUP BY author_id)
SELECT author_id, count(*) AS total_scored, {r4('sum(score) / count(*)', 1)} AS average_score, {r4('100.0 * count(*) FILTER (WHERE score < 47) / count(*)', 1)} AS low_percent, max(domains) AS domains FROM n JOIN s USING (author_id) GROUP BY author_id""")
def user_summaries(spark, sf):
    shown = F.transform("domains", lambda d: F.concat_ws(":", d["domain"], F.round(d["mean"] * 10).cast("long").cast("string")))
    return A.user_summaries(score_events(spark, sf)).withColumn("domains", F.array_join(shown, ","))


@query(f"SELECT repo_id, {r4('avg(score)', 1)} AS average_score, count(*) AS count FROM {EVENTS} GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def personal_summary(spark, sf):
    return A.personal_summary(score_events(spark, sf), "repo_id")


_URL = "CASE WHEN event_id % 7 = 0 THEN 'https://example.org/x' ELSE 'https://github.com/org' || CAST(event_id % 3 AS VARCHAR) || '/' || repo_id || '/pull/' || CAST(event_id AS VARCHAR) END"


@query(f"""WITH e AS (SELECT regexp_extract({_URL}, 'github\\.com/([^/]+/[^/]+)', 1) AS repo, score, CASE WHEN event_id % 2 = 0 THEN 0.8e0 ELSE 0.5e0 END AS impact FROM (SELECT * FROM {EVENTS} ORDER BY ts DESC, event_id DESC LIMIT 5000))
SELECT repo, {r4('avg(score)', 1)} AS score, {r4('avg(impact)', 2)} AS reviewer_impact, count(*) AS pr_count FROM e WHERE starts_with(repo, 'org1/') GROUP BY repo ORDER BY 2 DESC, 1 LIMIT 50""")
def repo_leaderboard(spark, sf):
    url = F.when(F.col("event_id") % 7 == 0, "https://example.org/x").otherwise(F.concat(F.lit("https://github.com/org"), (F.col("event_id") % 3).cast("string"), F.lit("/"), "repo_id", F.lit("/pull/"), F.col("event_id").cast("string")))
    other = F.struct(F.lit("specificity").alias("name"), F.lit(0.1).alias("score"))
    told = F.struct(F.lit("reviewer_impact_proxy").alias("name"), F.lit(0.8).alias("score"))
    signals = F.when(F.col("event_id") % 2 == 0, F.array(other, told)).otherwise(F.array(other))
    return A.repo_leaderboard(score_events(spark, sf).withColumns({"url": url, "signals": signals}), org="org1")


_STATS = f"count(*) AS n, count(*) FILTER (WHERE score < 48) AS slop_count, {r4('count(*) FILTER (WHERE score < 48) / count(*)', 3)} AS slop_rate"


@query(f"""SELECT 'total' AS kind, '' AS key, {_STATS}, {r4('count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 0.01)', 1)} AS items_per_minute FROM {EVENTS} HAVING count(*) > 0
UNION ALL SELECT 'domain', domain, {_STATS}, NULL FROM {EVENTS} GROUP BY domain UNION ALL SELECT 'repo_id', repo_id, {_STATS}, NULL FROM {EVENTS} GROUP BY repo_id""")
def ingestion_stats(spark, sf):
    return A.ingestion_stats(score_events(spark, sf), 48.0)


@query(f"""WITH b AS (SELECT domain, avg(score) AS usual FROM {EVENTS} GROUP BY 1), m AS (SELECT max(ts) AS now FROM {EVENTS}),
e AS (SELECT *, (epoch_us(now) - epoch_us(ts)) / 1e6 AS age FROM {EVENTS}, m), r AS (SELECT e.*, usual FROM e JOIN b USING (domain) WHERE age <= 172800), n AS (SELECT * FROM r WHERE age <= 86400),
h AS (SELECT repo_id, count(*) AS c, avg(score) AS mean FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), t AS (SELECT domain FROM n GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT count(*) AS total, {r4('count(*) FILTER (WHERE score < usual - 1e-9) / greatest(count(*), 1)', 2)} AS slop_rate, (SELECT domain FROM t) AS top_domain, (SELECT repo_id FROM h) AS hottest_repo, (SELECT c FROM h) AS hottest_count,
(SELECT {r4('mean', 1)} FROM h) AS hottest_avg, {r4('avg(score)', 1)} AS avg_score, (SELECT {r4('avg(score)', 1)} FROM r WHERE age > 86400) AS previous_avg FROM n""")
def ticker_snapshot(spark, sf):
    return A.ticker_snapshot(score_events(spark, sf), 86_400)


@query(f"SELECT count(*) AS total_minutes, {r4('avg(m)', 1)} AS current_avg_score FROM (SELECT {r4('avg(score)')} AS m FROM {EVENTS} GROUP BY date_trunc('minute', ts))")
def live_history_summary(spark, sf):
    return A.history_summary(A.minute_history(score_events(spark, sf)))


@query(f"""SELECT author_id AS appeal_id, count(*) FILTER (WHERE score >= 50) AS upvotes, count(*) FILTER (WHERE score < 50) AS downvotes,
CASE WHEN count(*) < 5 THEN 'pending' WHEN count(*) FILTER (WHERE score >= 50) > count(*) FILTER (WHERE score < 50) THEN 'community_verified' ELSE 'community_disputed' END AS status FROM {EVENTS} GROUP BY 1""")
def vote_tally(spark, sf):
    e = score_events(spark, sf)
    return A.tally(e.select(F.col("author_id").alias("appeal_id"), F.when(F.col("score") >= 50, "up").otherwise("down").alias("vote")))


@query("SELECT source, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'de') AS n_de, count(*) FILTER (WHERE lang = 'fr') AS n_fr FROM documents GROUP BY source")
def label_distribution(spark, sf):
    return A.label_counts(table(spark, sf, "documents"), "source", "lang", ["en", "de", "fr"])


_BOUNDS = [("view", "mean", 10.0, None), ("view", "low", None, 5.0), ("click", "mean", None, 1e9), ("purchase", "mean", 1e9, None), ("absent", "mean", 0.0, 1.0), ("error", "low", None, None)]


@query(f"""WITH b(name, measure, low, high) AS (VALUES {", ".join(f"('{n}', '{m}', {'NULL' if a is None else f'{a}e0'}::DOUBLE, {'NULL' if b is None else f'{b}::DOUBLE'})" for n, m, a, b in _BOUNDS)}),
s AS (SELECT domain AS name, 'mean' AS measure, avg(score) AS value FROM {EVENTS} GROUP BY 1 UNION ALL SELECT domain, 'low', min(score) FROM {EVENTS} GROUP BY 1),
j AS (SELECT b.*, coalesce(value, -1) AS v FROM b LEFT JOIN s USING (name, measure))
SELECT name, count(*) AS checks, count(*) FILTER (WHERE v < low OR v > high) AS failed, count(*) FILTER (WHERE v < low OR v > high) = 0 AS passed FROM j GROUP BY name""")
def calibration_checks(spark, sf):
    e = score_events(spark, sf).groupBy(F.col("domain").alias("name"))
    scores = e.agg(F.avg("score").alias("mean"), F.min("score").alias("low")).unpivot("name", ["mean", "low"], "measure", "value")
    return A.calibration(scores, spark.createDataFrame(_BOUNDS, "name string, measure string, low double, high double"))


@query(f"SELECT domain, event_id, score FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM {EVENTS}) WHERE rn <= 250")
def bounded_log(spark, sf):
    return sinks.bounded(score_events(spark, sf)).select("domain", "event_id", "score")


@query(f"""WITH e AS (SELECT * FROM {EVENTS}), p AS (SELECT author_id AS user_id, arg_max(score, event_id) AS score, max(event_id) AS updated_at FROM e WHERE event_id % 2 = 0 GROUP BY 1),
c AS (SELECT author_id AS user_id, arg_max(score, event_id) AS score, max(event_id) AS updated_at FROM e WHERE event_id % 3 = 0 GROUP BY 1)
SELECT user_id, arg_max(score, updated_at * 2 + n) AS score, max(updated_at) AS updated_at FROM (SELECT *, 0 AS n FROM p UNION ALL SELECT *, 1 FROM c) GROUP BY user_id""")
def profile_upsert(spark, sf):
    e = score_events(spark, sf)
    one = lambda k: e.filter(F.col("event_id") % k == 0).groupBy(F.col("author_id").alias("user_id")).agg(F.max_by("score", "event_id").alias("score"), F.max("event_id").alias("updated_at"))
    return sinks.upserted(one(2), one(3))


# ---- labels and samples ------------------------------------------------------------------------------------------------

#: Sentences of our own that the weak labels tell apart.
_LABEL_SAMPLES = [
    "Fixes #42 because p99 went from 340 ms to 85 ms, see table 3.", "This enhances user experience and is a robust solution, going forward.", "We considered an alternative in 2021.",
    "A robust solution.", "Nothing to see here.", "doi: 10.1234 figure 2 and 12000 rows in app.py",
]
LABEL_TEXT = f"(SELECT doc_id, concat_ws(' ', text, {_list(_LABEL_SAMPLES)}[doc_id % {len(_LABEL_SAMPLES)} + 1]) AS text FROM documents)"
# word boundaries of this SQL know ASCII only
_SHOWN = r"regexp_replace(text, '[^\P{L}\x00-\x7F]', 'x', 'g')"
_SHOWS = lambda ps: "(" + " + ".join(f"CAST(regexp_matches({_SHOWN}, '(?i){_q(p)}') AS INTEGER)" for p in ps) + ")"


WEAK = rf"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, {_SHOWS(D.SPECIFIC)} AS spec, {_SHOWS(D.STOCK)} AS slop FROM {LABEL_TEXT}),
l AS (SELECT *, CASE WHEN n < 40 THEN NULL WHEN spec >= 3 THEN 'reviewed' WHEN slop >= 2 THEN 'slop' WHEN spec >= 2 AND slop = 0 THEN 'reviewed' WHEN slop >= 1 AND spec = 0 THEN 'slop' END AS label FROM c)
SELECT doc_id, label, coalesce(label, CASE WHEN spec >= 1 THEN 'reviewed' ELSE 'slop' END) AS abstract_label FROM l"""


def label_text(spark, sf):
    """Whole documents, each followed by a sample."""
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "text", _pick(_LABEL_SAMPLES)).alias("text"))


@query(WEAK)
def weak_labels(spark, sf):
    return label_text(spark, sf).select("doc_id", D.weak_label(F.col("text")).alias("label"), D.abstract_label(F.col("text")).alias("abstract_label"))


_KINDS = ["reddit", "wiki", "medicine", "closed_qa", "elsewhere"]
_N_WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"


@query(f"""WITH c AS (SELECT conv_id AS id, {_list(_KINDS)}[conv_id % {len(_KINDS)} + 1] AS subset, role, turn, text FROM conversations),
r AS (SELECT id, subset, CASE role WHEN 'user' THEN 'reviewed' ELSE 'slop' END AS label, row_number() OVER (PARTITION BY id, role ORDER BY turn) - 1 AS pos, text FROM c WHERE role IN ('user', 'assistant')),
k AS (SELECT *, row_number() OVER (PARTITION BY subset, label ORDER BY id, pos) AS rn FROM r WHERE {_N_WORDS} >= 30)
SELECT id, CAST(pos AS INTEGER) AS pos, label, left(text, 1500) AS text, CASE subset WHEN 'reddit' THEN 'social_news' WHEN 'medicine' THEN 'academia' WHEN 'closed_qa' THEN 'communications' ELSE 'content' END AS domain, 'hc3_' || subset AS source FROM k WHERE rn <= 2000""")
def answer_samples(spark, sf):
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(said("user").alias("human_answers"), said("assistant").alias("chatgpt_answers"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("id") % len(_KINDS) + 1).cast("int"))
    return D.answer_samples(rows.withColumn("subset", kind), most=2000)


_MODELS = ["human", "gpt-4", "Claude", "unknown", "reviewed"]
_FIELDS = ["news", "abstracts", "Reviews", "other"]


@query(rf"""WITH d AS (SELECT doc_id AS id, regexp_replace(coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE text END, ''), text, ''), '^\s+|\s+$', '', 'g') AS text,
  lower({_list(_MODELS)}[doc_id % {len(_MODELS)} + 1]) AS raw, lower({_list(_FIELDS)}[doc_id % {len(_FIELDS)} + 1]) AS kind FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY left(text, 80) ORDER BY id) AS rn FROM d WHERE {_N_WORDS} >= 20),
l AS (SELECT *, CASE WHEN raw IN ('human', 'reviewed') THEN 'reviewed' WHEN raw IN ('gpt-4', 'claude') THEN 'slop' END AS label FROM f WHERE rn = 1)
SELECT id, left(text, 1500) AS text, label, CASE kind WHEN 'abstracts' THEN 'academia' WHEN 'reviews' THEN 'marketplace' ELSE 'content' END AS domain, 'raid_' || kind AS source FROM l WHERE label IS NOT NULL ORDER BY id LIMIT 3000""")
def generation_samples(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id IS NOT NULL")
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % len(v) + 1).cast("int"))
    generation = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))
    rows = d.select(F.col("doc_id").alias("id"), generation.alias("generation"), "text", pick(_MODELS).alias("label"), pick(_FIELDS).alias("domain"))
    return D.generation_samples(rows, most=3000)


@query("""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), b AS (SELECT * FROM d WHERE id % 3 = 0), m AS (SELECT * FROM d WHERE id % 3 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY left(text, 80) ORDER BY id) AS rn FROM m WHERE left(text, 80) NOT IN (SELECT left(text, 80) FROM b)) SELECT id FROM b UNION ALL SELECT id FROM n WHERE rn = 1""")
def merged_samples(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return D.merged(d.filter("id % 3 = 0"), d.filter("id % 3 != 0")).select("id")


# ---- markup ------------------------------------------------------------------------------------------------------------

_FEED = "<feed><title>Feed</title>{}</feed>"
_ENTRY = "<entry><id>http://x/{i}</id><title type=\"text\">Title\n  {i}</title><summary>{s}</summary></entry>"
_LONG = "A summary that goes on for long enough to be kept, with\n line breaks and  blanks."
_FEEDS = [_FEED.format("".join(_ENTRY.format(i=i, s=_LONG if i % 2 else "short") for i in range(n))) for n in (0, 1, 3, 5)]
_ARTICLES = ["<a><ArticleTitle>One <i>two</i></ArticleTitle><AbstractText Label=\"X\">" + _LONG + " <b>bold</b></AbstractText><ArticleTitle>Three</ArticleTitle><AbstractText>short</AbstractText></a>", "<none/>"]
_PART = "Some words of a section that are long enough to be kept as a sample of documentation, eighty and more."
_READMES = [base64.b64encode(x.encode()).decode() for x in ("# Title\nintro\n## Setup\n" + _PART + "\n### Use é\nshort\n#### deep " + _PART + "\n# Last\n" + _PART * 9, "no heading", "a\n## B\n  " + _PART + "\n")]
_BATCHES = ["First item --- A pull request text\n---\n\n--- Documentation of it", "", "Only a Review of an Abstract", "--- resume ---"]
_CITATIONS = ["Smith J. \"A title of some length\" 2019. doi: 10.1234/abc.DEF-9 12345678", "PMID: 23456789 A Long Title Case Run Of Words Here", "see 7654321 only", "nothing", "The Quick Brown Fox Jumps Over It, again. 10.99999/x(1)2"]


def _rows(spark, sf, values, name):
    return corpus(spark, sf).select("doc_id", _pick(values).alias(name))


_ONE = lambda values: f"(SELECT doc_id, {_array(values)}[doc_id % {len(values)} + 1] AS x FROM {CORPUS})"
_CLEAN = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query(rf"""WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(x, '(?s)<title[^>]*>(.*?)</title>', 1), lambda v: {_CLEAN('v')})[2:] AS t, list_transform(regexp_extract_all(x, '(?s)<summary[^>]*>(.*?)</summary>', 1), lambda v: {_CLEAN('v')}) AS s,
  list_transform(regexp_extract_all(x, '(?s)<id[^>]*>(.*?)</id>', 1), lambda v: {_CLEAN('v')})[2:] AS l FROM {_ONE(_FEEDS)}), e AS (SELECT *, unnest(range(1, greatest(len(t), len(s), len(l)) + 1)) AS i FROM f)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS title, left(s[i], 800) AS summary, l[i] AS link FROM e WHERE length(left(s[i], 800)) >= 50""")
def atom_entries(spark, sf):
    return M.atom_entries(_rows(spark, sf, _FEEDS, "xml"), ["doc_id"])


@query(rf"""WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(x, '(?s)<ArticleTitle[^>]*>(.*?)</ArticleTitle>', 1), lambda v: {_CLEAN("regexp_replace(v, '<[^>]+>', '', 'g')")}) AS t,
  list_transform(regexp_extract_all(x, '(?s)<AbstractText[^>]*>(.*?)</AbstractText>', 1), lambda v: {_CLEAN("regexp_replace(v, '<[^>]+>', '', 'g')")}) AS s FROM {_ONE(_ARTICLES)}), e AS (SELECT *, unnest(range(1, greatest(len(t), len(s)) + 1)) AS i FROM f)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS title, left(s[i], 800) AS abstract FROM e WHERE length(left(s[i], 800)) >= 50""")
def article_entries(spark, sf):
    return M.article_entries(_rows(spark, sf, _ARTICLES, "xml"), ["doc_id"])


@query(rf"""WITH f AS (SELECT doc_id, string_split_regex(decode(from_base64(x)), '\n#{{1,3}}\s+')[2:] AS p FROM {_ONE(_READMES)}), e AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM f)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(p[i], '^\s+|\s+$', '', 'g') AS text FROM e WHERE length(regexp_replace(p[i], '^\s+|\s+$', '', 'g')) BETWEEN 80 AND 800""")
def readme_sections(spark, sf):
    return M.readme_sections(_rows(spark, sf, _READMES, "content"), ["doc_id"])


_NAMED = "CASE " + " ".join(f"WHEN contains(lower(t), '{w}') THEN '{d}'" for w, d in M.NAMED_DOMAINS) + " ELSE 'general' END"


@query(rf"""WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(x, '---'), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS p FROM {_ONE(_BATCHES)}), e AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM f)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, t AS text, {_NAMED} AS domain FROM e""")
def batch_items(spark, sf):
    return M.batch_items(_rows(spark, sf, _BATCHES, "text"), ["doc_id"])


@query(rf"""SELECT doc_id, nullif(regexp_extract(x, '(10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+)', 1), '') AS doi, coalesce(nullif(regexp_extract(x, '(?i)PMID[:\s]*(\d{{5,9}})', 1), ''), CASE WHEN NOT contains(lower(x), 'doi') THEN nullif(regexp_extract(x, '\b(\d{{7,9}})\b', 1), '') END) AS pmid,
coalesce(nullif(regexp_extract(x, '"([^"]{{10,}})"', 1), ''), regexp_replace(nullif(regexp_extract(x, '([A-Z][A-Za-z\s,'':\-]{{20,80}})', 1), ''), '^\s+|\s+$', '', 'g')) AS title FROM {_ONE(_CITATIONS)}""")
def citation_ids(spark, sf):
    return _rows(spark, sf, _CITATIONS, "x").select("doc_id", M.citation_ids(F.col("x")).alias("c")).select("doc_id", "c.*")


# ---- the whole result of a document ------------------------------------------------------------------------------------


@query()
def score_reports(spark, sf):
    out = scoring.score_documents(corpus(spark, sf), ["doc_id", "domain"], explain=True)
    return out.select("doc_id", "domain", "score", "oversight", "summary", F.size("reasons").alias("n_reasons"), F.size("highlights").alias("n_highlights"), "top_signal", "flagged", F.size("signals").alias("n_signals"))


@query(f"SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]')) AS first_letter, CAST(ceil(length(text) / 250.0) AS INTEGER) AS n_tiles FROM {CORPUS}")
def text_tiles(spark, sf):
    return corpus(spark, sf).select("doc_id", F.lower(F.regexp_extract("text", "[A-Za-z]", 0)).alias("first_letter"), F.size(T.tiles(F.col("text"), 250)).alias("n_tiles"))
