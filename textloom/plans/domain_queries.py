"""Queries of the domain signals and the SQL that checks them: the patterns are shared, the formulas are written anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import domain_patterns as P
from textloom.operators import domains as DS
from textloom.plans.queries import CORPUS, LATIN, SENTS, TOKS, _list, query, r4
from textloom.plans.stance_queries import _MARKED as MARKED
from textloom.plans.stance_queries import _count, _q
from textloom.sources.readers import corpus

#: Changes and review comments of our own, dealt to documents by their id.
DIFFS = [
    "",
    "--- a/billing/retry.py\n+++ b/billing/retry.py\n@@ -1,2 +1,4 @@\n+def cap_retries(count):  # because duplicate charges hit a customer\n+    return min(count, 3)  # cap_retries\n-    return count",
    "+const windowMinutes = 10 // ensure webhook delivery stays idempotent\n+let total = windowMinutes // windowMinutes",
    "-old line\n unchanged",
    "+/* hotfix: avoid the leak */\n+class Session:\n+type Alias = number\n+++ not added",
    "+func (s *Server) Close() {}\n+/* first */ x = 1\n+y = 2 # TODO quick fix\n+# note: the spec has an edge-case",
]
COMMENTS = [[], ["lgtm"], ["Why not instead use a queue?", "ok", "I disagree, but fine", "```x```"], ["nice", "good", "great", "cool"]]


def _pick(values: list) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") for v in values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def change_corpus(spark, sf):
    """Documents with a change and its review comments; every one is a change description."""
    return corpus(spark, sf).select("doc_id", F.lit("code_review").alias("domain"), F.concat_ws(" ", "text", _pick(P.SAMPLES)).alias("text"), _pick(DIFFS).alias("diff"), _pick(COMMENTS).alias("comments"))


def sample_corpus(spark, sf):
    return corpus(spark, sf).withColumn("text", F.concat_ws(" ", "text", _pick(P.SAMPLES)))


_SAMPLES = f"{_list(P.SAMPLES)}[doc_id % {len(P.SAMPLES)} + 1]"
_TEXT = f"(SELECT doc_id, domain, concat_ws(' ', text, {_SAMPLES}) AS text FROM {CORPUS})"


def _counts(d: str) -> str:
    # marks and places that depend on line or blank keep the text; words are looked up where letters beyond ASCII are word characters
    own = "marked" if d == "docs" else "latin"
    return ", ".join(f"{_count('text' if n in ('headings', 'examples', 'dashes', 'shouting') else own, ('' if n in P.WITH_CASE else '(?i)') + p)} AS {n}" for n, p in P.COUNTS[d].items())


#: signal: (score, weight, lowest score of the first label, first label, other label) over the counts of its domain
_FORMULAS = {
    "hiring": [
        ("company_and_achievement_specificity", "company * 0.08e0 + quantified * 0.12e0 + metrics * 0.15e0 + products * 0.06e0 - padding * 0.07e0", 1.0, 0.5, "specific", "generic_application"),
        ("structural_template_detection", "0.55e0 + role * 0.06e0 - template * 0.15e0", 1.2, 0.55, "candidate_specific", "templated_application"),
        ("batch_structural_fingerprint", """1e0 - 0.18e0 * (CASE WHEN m = 0 THEN 0 ELSE 2 * CAST(intro AS INTEGER) + 2 * CAST(outro AS INTEGER) + CASE WHEN m BETWEEN 3 AND 8 AND s1 AND s2 AND s3 THEN 3 ELSE 0 END
           + CASE WHEN m >= 3 AND most >= 3 THEN 1 ELSE 0 END END)""", 1.8, 0.6, "organic_structure", "ai_cover_letter_pattern"),
    ],
    "communications": [
        ("decision_action_density", "1e0 * actions / greatest(m, 1)", 1.2, 0.45, "actionable", "inflated_comms"),
        ("compression_score", "1e0 - (n_words - actions * 9e0) / greatest(n_words, 1) * 0.55e0", 1.0, 0.55, "compact", "overexpanded"),
        ("reply_information_score", "greatest(0e0, 1e0 - acks / greatest(m, 1) * 0.7e0) - CASE WHEN n_words < 10 AND 2 * acks > greatest(m, 1) THEN 0.2e0 ELSE 0e0 END", 0.8, 0.6, "informative_reply", "low_info_reply"),
        ("meeting_notes_substance", "(items + owners + deadlines) * 0.15e0 + 0.3e0 - talk * 0.06e0", 0.9, 0.55, "actionable_notes", "discussion_summary_only"),
    ],
    "content": [
        ("claim_specificity", "1e0 - (claims + weasel) * 1e0 / greatest(claims + weasel + evidence + cited, 1)", 1.2, 0.55, "supported", "unsupported_claims"),
        ("time_to_value_ratio", "(specifics * 18e0 + evidence * 10e0) / greatest(n_words, 1)", 1.0, 0.3, "high_payoff", "low_payoff"),
        ("structure_rehash", "1e0 - least(1e0, rehash * 0.18e0)", 0.8, 0.65, "fresh_structure", "seo_template"),
        ("originality_proxy", "CASE WHEN m = 0 THEN 0.4e0 ELSE own * 0.2e0 + 0.4e0 - generic * 0.12e0 END", 0.9, 0.55, "original_voice", "generic_content"),
    ],
    "marketplace": [
        ("review_specificity", "details * 0.12e0 + units * 0.15e0 - praise * 0.08e0 + 0.35e0", 1.2, 0.55, "buyer_specific", "generic_review"),
        ("reviewer_history_authenticity_proxy", "0.35e0 + details * 0.1e0 + timing * 0.08e0 + units * 0.1e0 - praise * 0.08e0", 1.0, 0.55, "experience_grounded", "generic_review_pattern"),
        ("temporal_clustering_proxy", "0.3e0 + periods * 0.15e0 + usage * 0.12e0", 0.9, 0.55, "time_grounded", "temporally_vague"),
        ("pros_cons_balance", "CASE WHEN pros + cons >= 2 THEN 0.4e0 + least(pros, cons) / (pros + cons) * 0.6e0 ELSE 0.35e0 END", 0.8, 0.55, "balanced_review", "one_sided_review"),
    ],
    "social_news": [
        ("rage_bait_fingerprint", "0.55e0 + sourced * 0.1e0 - emotional * 0.1e0 - (capitals - acronyms) * 0.06e0 - shouting * 0.08e0", 1.1, 0.6, "sourced", "engagement_bait_risk"),
        ("network_coordination_proxy", "0.65e0 + sourced * 0.08e0 - coordinated * 0.16e0", 0.9, 0.6, "organic_language", "coordination_risk"),
        ("posting_cadence_proxy", "CASE WHEN n_words > 20 THEN 0.35e0 + voice * 0.1e0 + informal * 0.08e0 + contractions * 0.04e0 ELSE 0.5e0 END", 0.8, 0.55, "human_voice", "automated_tone"),
        ("engagement_authenticity_proxy", "0.7e0 - (calls + outrage + emotional * 0.3e0) * 0.1e0", 0.9, 0.55, "authentic_engagement", "engagement_farming"),
    ],
    "docs": [
        ("heading_to_content_ratio", "1e0 - headings * 35e0 / greatest(n_words, 1)", 1.0, 0.65, "substantive", "outline_heavy"),
        ("concrete_example_density", "1e0 * examples / greatest(headings, 1)", 1.1, 0.45, "example_rich", "example_poor"),
        ("circular_explanation_graph", "1e0 - circular * 1e0 / greatest(m - 2, 1) - least(family * 1e0 / greatest(n_words, 1) * 2e0, 0.85e0)", 1.5, 0.7, "adds_new_information", "circular_explanation"),
        ("codebase_drift_proxy", "1e0 - (stale + years * 0.5e0 + old_versions * 0.3e0 + placeholders) * 0.1e0", 0.9, 0.65, "current", "stale_content_risk"),
    ],
    "academia": [
        ("academic_grounding", "citations * 0.09e0 + cautions * 0.08e0", 1.1, 0.5, "grounded", "ungrounded_academic_style"),
        ("stylistic_consistency", "CASE WHEN n_tiles < 2 THEN 1e0 ELSE 1e0 - drift / 3 * 0.8e0 END", 0.9, 0.7, "consistent", "style_shift"),
        ("self_citation_inflation", "1e0 - own_work * 0.12e0", 0.7, 0.7, "normal_self_reference", "self_reference_heavy"),
        ("citation_claim_alignment", "CASE WHEN n_cited = 0 THEN 0.4e0 ELSE 0.4e0 + firm * 1e0 / greatest(firm + vague, 1) * 0.5e0 END", 0.8, 0.6, "verified_citations", "vague_references"),
    ],
}

#: What some domains need beside counts, over s (sentences), toks and text.
_MORE = {
    "hiring": ", " + ", ".join([
        f"coalesce(regexp_matches(s[1], '(?i){P.LETTER_INTRO}'), false) AS intro", f"len(s) > 1 AND coalesce(regexp_matches(s[-1], '(?i){P.LETTER_OUTRO}'), false) AS outro",
        f"coalesce(regexp_matches(s[1], '(?i){P.SANDWICH[0]}'), false) AS s1", f"len(list_filter(s[2:len(s) - 1], lambda x: regexp_matches(x, '(?i){P.SANDWICH[1]}'))) > 0 AS s2",
        f"len(s) > 1 AND coalesce(regexp_matches(s[-1], '(?i){P.SANDWICH[2]}'), false) AS s3",
        f"""(SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_transform(list_filter(list_transform(s, lambda x: {TOKS.format('x')}), lambda w: len(w) > 0), lambda w: array_to_string(w[1:2], ' '))) AS o) GROUP BY o)) AS most""",
    ]),
    "content": f""", len(list_filter(s, lambda x: regexp_matches(x, '{P.ORIGINAL_NAME}') OR regexp_matches(x, '(?i){P.ORIGINAL_DATA}') OR regexp_matches(x, '{P.ORIGINAL_QUOTE}'))) AS own,
      len(list_filter(s, lambda x: NOT (regexp_matches(x, '{P.ORIGINAL_NAME}') OR regexp_matches(x, '(?i){P.ORIGINAL_DATA}') OR regexp_matches(x, '{P.ORIGINAL_QUOTE}')) AND regexp_matches(x, '(?i){_q(P.GENERIC_OPENING)}'))) AS generic""",
    "docs": f""", list_transform(s, lambda x: list_distinct(list_filter({TOKS.format('x')}, lambda w: length(w) > 3))) AS sets""",
}

_DOCS = """, docs_circular AS (SELECT doc_id, count(*) AS circular FROM (SELECT doc_id, sets[i] AS a, sets[i + 1] AS b, sets[i + 2] AS c FROM (SELECT doc_id, sets, unnest(range(1, len(sets) - 1)) AS i FROM docs0))
  WHERE len(a) + len(b) > 0 AND len(list_filter(c, lambda w: NOT list_contains(a, w) AND NOT list_contains(b, w))) <= 1
  AND len(list_intersect(a, c)) / greatest(len(a) + len(c) - len(list_intersect(a, c)), 1) > 0.5 GROUP BY doc_id),
docs_words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS w FROM docs0) WHERE length(w) >= 6 GROUP BY ALL),
docs_family AS (SELECT doc_id, sum(n) AS family FROM (SELECT doc_id, left(w, 6) AS stem, sum(n) AS n FROM docs_words GROUP BY ALL HAVING count(*) >= 3) GROUP BY doc_id),
docs AS (SELECT docs0.*, coalesce(circular, 0) AS circular, coalesce(family, 0) AS family FROM docs0 LEFT JOIN docs_circular USING (doc_id) LEFT JOIN docs_family USING (doc_id))"""
_ACADEMIA = rf""", tiles AS (SELECT doc_id, unnest(list_filter(list_transform(range(0, (length(text) + 249) // 250), lambda i: substr(text, i * 250 + 1, 250)), lambda x: regexp_matches(x, '\S'))) AS text FROM academia0),
tile_words AS (SELECT doc_id, {TOKS.format('text')} AS w, len({SENTS}) AS s FROM tiles),
tile_features AS (SELECT doc_id, list_sum(list_transform(w, lambda x: length(x))) / len(w) AS a, len(w) / greatest(s, 1) AS b, len(list_distinct(w)) / len(w) AS c FROM tile_words WHERE len(w) > 0),
drifts AS (SELECT doc_id, count(*) AS n_tiles, coalesce((max(a) - min(a)) / nullif(avg(a), 0), 0) + coalesce((max(b) - min(b)) / nullif(avg(b), 0), 0) + coalesce((max(c) - min(c)) / nullif(avg(c), 0), 0) AS drift FROM tile_features GROUP BY doc_id),
gaps AS (SELECT doc_id, text, string_split_regex(text, '{P.CITATION}') AS g, regexp_extract_all(text, '{P.CITATION}') AS c FROM academia0),
places AS (SELECT doc_id, text, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(c[1:i - 1], lambda x: length(x))), 0) AS a, length(c[i]) AS n
  FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM gaps)),
around AS (SELECT doc_id, lower(substr(text, CAST(greatest(a - 80, 0) + 1 AS BIGINT), CAST(a + n + 30 - greatest(a - 80, 0) AS BIGINT))) AS x FROM places),
cites AS (SELECT doc_id, count(*) AS n_cited, count(*) FILTER (WHERE regexp_matches(x, '{P.CITED_FIRMLY}')) AS firm, count(*) FILTER (WHERE NOT regexp_matches(x, '{P.CITED_FIRMLY}') AND regexp_matches(x, '{P.CITED_VAGUELY}')) AS vague FROM around GROUP BY doc_id),
academia AS (SELECT academia0.*, coalesce(n_tiles, 0) AS n_tiles, coalesce(drift, 0) AS drift, coalesce(n_cited, 0) AS n_cited, coalesce(firm, 0) AS firm, coalesce(vague, 0) AS vague
  FROM academia0 LEFT JOIN drifts USING (doc_id) LEFT JOIN cites USING (doc_id))"""


def _signal_rows(d: str) -> list[str]:
    return [
        f"SELECT doc_id, '{d}' AS domain, '{name}' AS signal, {r4(f'greatest(0e0, least(1e0, {score}))', 3)} AS score, {weight}e0 AS weight, CASE WHEN greatest(0e0, least(1e0, {score})) >= {cut}e0 THEN '{high}' ELSE '{low}' END AS label FROM {d}"
        for name, score, weight, cut, high, low in _FORMULAS[d]
    ]


def _domain_sql(domains: list[str]) -> str:
    ctes, more = [], ""
    for d in domains:
        name = f"{d}0" if d in ("docs", "academia") else d
        ctes.append(f"{name} AS (SELECT *, len(toks) AS n_words, len(s) AS m, {_counts(d)}{_MORE.get(d, '')} FROM t WHERE domain = '{d}')")
        more += {"docs": _DOCS, "academia": _ACADEMIA}.get(d, "")
    rows = " UNION ALL ".join(r for d in domains for r in _signal_rows(d))
    return f"WITH t AS (SELECT *, {LATIN} AS latin, {MARKED} AS marked, {SENTS} AS s, {TOKS.format('text')} AS toks FROM {_TEXT}), {', '.join(ctes)}{more} SELECT * FROM ({rows})"


def _of(spark, sf, domains):
    return DS.domain_signals(sample_corpus(spark, sf).filter(F.col("domain").isin(*domains)), ["doc_id"])


_PROSE = ["hiring", "communications", "content", "marketplace", "social_news"]


@query(_domain_sql(_PROSE))
def domain_signals(spark, sf):
    return _of(spark, sf, _PROSE)


@query(_domain_sql(["docs"]))
def docs_signals(spark, sf):
    return _of(spark, sf, ["docs"])


@query(_domain_sql(["academia"]))
def academia_signals(spark, sf):
    return _of(spark, sf, ["academia"])


def _array(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(v, str) else f"CAST({_list(v)} AS VARCHAR[])" for v in values) + "]"


_LONG = lambda x: f"list_distinct(list_filter({TOKS.format(x)}, lambda w: length(w) > 3))"
_CHANGES = f"""c0 AS (SELECT doc_id, concat_ws(' ', text, {_SAMPLES}) AS text, {_array(DIFFS)}[doc_id % {len(DIFFS)} + 1] AS diff, {_array(COMMENTS)}[doc_id % {len(COMMENTS)} + 1] AS comments FROM {CORPUS}),
c1 AS (SELECT *, list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')) AS added FROM c0),
c2 AS (SELECT doc_id, i, trim(substr(added[i], 2)) AS body FROM (SELECT doc_id, added, unnest(range(1, len(added) + 1)) AS i FROM c1)),
c3 AS (SELECT doc_id, i, CASE WHEN regexp_extract(body, '//\\s*(.+)', 1) <> '' THEN regexp_extract(body, '//\\s*(.+)', 1) ELSE regexp_extract(body, '#\\s*(.+)', 1) END AS line, regexp_extract(body, '/\\*\\s*(.+?)\\s*\\*/', 1) AS block FROM c2),
c4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c3 WHERE line <> '' OR block <> ''),
c5 AS (SELECT doc_id, i, CASE WHEN line <> '' THEN line ELSE block END AS comment FROM c4 WHERE line <> '' OR k = 1),
ids AS (SELECT doc_id, list_distinct(list_transform(flatten(list_transform(added, lambda x: list_concat({", ".join(f"regexp_extract_all(x, '{p}', 1)" for p in P.DECLARATIONS)}))), lambda x: lower(x))) AS names FROM c1),
c6 AS (SELECT c5.doc_id, i, comment, names, list_distinct(regexp_extract_all(lower(comment), '[a-z]+')) AS ws, {_count('comment', '(?i)' + P.COMMENT_BUSINESS)} AS business, {_count('comment', '(?i)' + P.COMMENT_REASON)} AS reasons FROM c5 JOIN ids USING (doc_id)),
c7 AS (SELECT doc_id, i, left(comment, 100) AS text, greatest(0e0, least(1e0, 0.4e0 + business * 0.08e0 + reasons * 0.1e0 - len(list_intersect(ws, names)) / greatest(len(ws), 1) * 0.4e0)) AS score,
  len(list_intersect(ws, names)) / greatest(len(ws), 1) AS shared, business, reasons FROM c6)"""


@query(f"WITH {_CHANGES} SELECT doc_id, text, {r4('score', 3)} AS score, {r4('shared', 2)} AS identifier_overlap, CAST(business AS INTEGER) AS business_words, CAST(reasons AS INTEGER) AS reasoning_words FROM c7")
def diff_comments(spark, sf):
    from textloom.functions.text import rounded

    scored = DS.comment_scores(DS.diff_comments(F.col("diff")), DS.diff_identifiers(F.col("diff")))
    return change_corpus(spark, sf).select("doc_id", F.inline(scored)).withColumn("score", rounded(F.col("score"), 3))


@query(f"WITH {_CHANGES} SELECT doc_id, unnest(names) AS name FROM ids")
def diff_identifiers(spark, sf):
    return change_corpus(spark, sf).select("doc_id", F.explode(DS.diff_identifiers(F.col("diff"))).alias("name"))


_COMMENT = " OR ".join(f"regexp_matches(c, '(?i){p}')" for p in P.ENGAGEMENT)
_KINDS = " + ".join(f"CAST(len(list_filter(comments, lambda c: regexp_matches(c, '(?i){p}'))) > 0 AS INTEGER)" for p in P.ENGAGEMENT)


@query(f"""WITH {_CHANGES}, f AS (SELECT c1.*, {LATIN} AS latin, CASE WHEN diff = '' THEN 0.5e0 WHEN len({_LONG('text')}) = 0 OR len({_LONG('diff')}) = 0 THEN 1e0 ELSE 1e0 - len(list_intersect({_LONG('text')}, {_LONG('diff')})) / len({_LONG('text')}) END AS divergence,
  CASE WHEN len(comments) = 0 THEN 0e0 ELSE least(1e0, least(1e0, len(list_filter(comments, lambda c: {_COMMENT})) / greatest(len(comments), 3)) + ({_KINDS}) * 0.05e0) END AS impact,
  {_count("concat_ws(' ', text, diff)", '(?i)' + P.VELOCITY)} AS rushed FROM c1),
g AS (SELECT *, {_counts('code_review')} FROM f),
k AS (SELECT doc_id, {r4('avg(score)', 3)} AS intelligence FROM c7 GROUP BY doc_id),
r AS (SELECT *, greatest(0e0, least(1e0, (reasons + CAST(dashes > 0 AS INTEGER) + 0.5e0) / (reasons + CAST(dashes > 0 AS INTEGER) + changes + 2))) AS ratio FROM g)
SELECT * FROM (SELECT doc_id, 'code_review' AS domain, 'pr_diff_divergence' AS signal, {r4('divergence', 3)} AS score, 1.5e0 AS weight, CASE WHEN divergence >= 0.62 THEN 'adds_context' ELSE 'diff_restatement' END AS label FROM r
UNION ALL SELECT doc_id, 'code_review', 'reviewer_impact_proxy', CASE WHEN len(comments) = 0 THEN 0.4e0 ELSE {r4('impact', 3)} END, 0.9e0, CASE WHEN impact >= 0.6e0 THEN 'active_review' ELSE 'rubber_stamp_risk' END FROM r
UNION ALL SELECT doc_id, 'code_review', 'code_comment_intelligence', coalesce(intelligence, 0.5e0), 1e0, CASE WHEN coalesce(intelligence, 0.5e0) >= 0.6 THEN 'explains_why' ELSE 'restates_code' END FROM r LEFT JOIN k USING (doc_id) WHERE len(added) > 0
UNION ALL SELECT doc_id, 'code_review', 'commit_reasoning_ratio', {r4('ratio', 3)}, 0.8e0, CASE WHEN ratio >= 0.55 THEN 'reasoned_commit' ELSE 'action_only_commit' END FROM r
UNION ALL SELECT doc_id, 'code_review', 'slop_velocity_proxy', {r4('greatest(0e0, 0.6e0 - rushed * 0.12e0)', 3)}, 1.1e0, 'velocity_pressure' FROM r)""")
def code_review_signals(spark, sf):
    return DS.domain_signals(change_corpus(spark, sf), ["doc_id"])
