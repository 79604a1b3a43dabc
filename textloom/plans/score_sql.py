"""The SQL of the whole score: the signals' own SQL over one text, weighted and added up."""

from __future__ import annotations

from textloom.plans import domain_queries as DQ
from textloom.plans import reasoning_queries as RQ
from textloom.plans import stance_queries as SQ
from textloom.plans.queries import CORPUS, ORACLES, SENTS, r4

#: signal -> (query, column, value where the query has no row, weight)
PARTS = {
    "semantic_uniqueness": ("sig_semantic_uniqueness", 0.5, "1.0e0"), "human_delta": ("sig_human_delta", 0.0, "0.3e0"), "information_density": ("sig_information_density", 0.5, "1.0e0"),
    "why_vs_what": ("sig_why_vs_what", 0.0, "1.8e0"), "template_structure": ("sig_template_structure", 0.5, "1.0e0"),
    "specificity": ("sig_specificity", 0.5, "CASE WHEN n_sents = 0 THEN 1.2e0 ELSE 1.8e0 END"), "evidence_density": ("sig_evidence_density", 0.5, "CASE WHEN n_sents < 2 THEN 0.8e0 ELSE 1.0e0 END"),
    "epistemic_cowardice": ("sig_epistemic_cowardice", 0.5, "1.5e0"), "counterfactual_absence": ("sig_counterfactual_absence", 0.5, "1.8e0"),
    "vocabulary_novelty": ("sig_vocabulary_novelty", 0.5, "1.6e0"),
}
#: Texts with samples of a query's own, which the score does without.
_OWN = {SQ.STANCE: f"(SELECT doc_id, text FROM {CORPUS})", RQ._TEXT: f"(SELECT doc_id, text, domain FROM {CORPUS})", DQ._TEXT: f"(SELECT doc_id, domain, text FROM {CORPUS})"}


def _of(name: str) -> str:
    sql = ORACLES[name]
    for own, plain in _OWN.items():
        sql = sql.replace(own, plain)
    return sql


def _changes() -> str:
    """The signals of a change without a diff and without comments."""
    sql = _of("code_review_signals")
    start, end = sql.index("c0 AS ("), sql.index("\nc1 AS (")
    return sql[:start] + f"c0 AS (SELECT doc_id, text, '' AS diff, CAST([] AS VARCHAR[]) AS comments FROM {CORPUS} WHERE domain = 'code_review')," + sql[end:]


def score_sql() -> str:
    domains = " UNION ALL ".join(f"SELECT doc_id, score, weight FROM ({x})" for x in (_of("domain_signals"), _of("docs_signals"), _of("academia_signals"), _changes()))
    joins = " ".join(f"LEFT JOIN ({_of(q)}) AS q_{s} USING (doc_id)" for s, (q, _, _) in PARTS.items())
    values = ", ".join(f"coalesce(q_{s}.{s}, {none}e0) AS {s}" for s, (_, none, _) in PARTS.items())
    own = " + ".join(f"{s} * {w}" for s, (_, _, w) in PARTS.items())
    weights = " + ".join(w for _, _, w in PARTS.values())
    names = ", ".join(f"CASE WHEN short THEN {s} ELSE {s} END AS {s}" for s in PARTS)
    return rf"""WITH base AS (SELECT doc_id, domain, len({SENTS}) AS n_sents, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS size, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) < 3 AS short FROM {CORPUS}),
dom AS (SELECT doc_id, sum(score * weight) AS ds, sum(weight) AS dw FROM ({domains}) GROUP BY doc_id),
vals AS (SELECT base.*, coalesce(ds, 0) AS ds, coalesce(dw, 0) AS dw, {values} FROM base LEFT JOIN dom USING (doc_id) {joins}),
total AS (SELECT *, CASE WHEN short THEN 0e0 ELSE {r4(f'({own} + ds) / ({weights} + dw) * 100', 1)} END AS score FROM vals)
SELECT doc_id, domain, {names}, score, CASE WHEN short OR size < 40 THEN 'insufficient' WHEN score >= 63 THEN 'high' WHEN score >= 47 THEN 'mixed' ELSE 'low' END AS oversight FROM total"""


ORACLES["score_documents"] = score_sql()
ORACLES["oversight_counts"] = f"SELECT domain, oversight, count(*) AS n, {r4('avg(score)', 2)} AS avg_score FROM ({ORACLES['score_documents']}) GROUP BY ALL"
