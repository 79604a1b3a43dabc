"""Clusters of whole texts and of vectors, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import tfidf as W
from textloom.operators import vector_index as V
from textloom.plans.queries import SENTS, TOKS, query, r4
from textloom.sources.readers import table

#: Ids of a batch: what one request would hold, so that pairs grow with the table and not with its square.
BATCH = 500
_TEXTS = f"(SELECT doc_id // {BATCH} AS batch, doc_id AS id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"
# weights of the 5000 most frequent words and pairs of words of a batch, then the cosine of all pairs of its texts
_COSINES = f"""d AS (SELECT batch, id, min(id) OVER (PARTITION BY batch, text) AS rep, text FROM {_TEXTS}),
w AS (SELECT batch, id, rep, regexp_extract_all(strip_accents(lower(text)), '{W.WORD}') AS ws FROM d),
t AS (SELECT batch, id, rep, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
f AS (SELECT batch, id, rep, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, term) AS rn FROM (SELECT batch, term, sum(tf) AS n, count(*) AS df FROM f GROUP BY batch, term)),
size AS (SELECT batch, count(*) AS docs FROM d GROUP BY batch),
x AS (SELECT f.batch, f.id, term, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS w FROM f JOIN v USING (batch, term) JOIN size USING (batch) WHERE id = rep AND rn <= {W.FEATURES}),
u AS (SELECT batch, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM x),
s AS (SELECT a.id AS a, b.id AS b, sum(a.u * b.u) AS c FROM u AS a JOIN u AS b ON a.batch = b.batch AND a.term = b.term AND a.id < b.id GROUP BY ALL),
p AS (SELECT a, b, {r4('c', 9)} AS similarity FROM s WHERE {r4('c', 9)} >= {W.LEAST})"""
# groups of documents: copies of a text are similar as well; batches follow one another by id, and links stay in one
_GROUPS = f"""{_COSINES},
k AS (SELECT DISTINCT id FROM u), m AS (SELECT d.id, d.rep FROM d JOIN k ON k.id = d.rep),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT id, id FROM k),
l AS (SELECT x.id AS a, y.id AS b FROM e JOIN m AS x ON x.rep = e.a JOIN m AS y ON y.rep = e.b WHERE x.id < y.id),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT a AS id FROM l UNION SELECT b FROM l)),
g AS (SELECT CAST([] AS BIGINT[]) AS leads, CAST(0 AS BIGINT) AS r
  UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.b = o.id AND list_contains(g.leads, l.a)) THEN g.leads ELSE list_append(g.leads, o.id) END, o.r FROM g JOIN o ON o.r = g.r + 1),
h AS (SELECT unnest(leads) AS leader FROM (SELECT leads FROM g ORDER BY r DESC LIMIT 1)),
z AS (SELECT leader, b AS id FROM h JOIN l ON l.a = h.leader UNION ALL SELECT leader, leader FROM h WHERE leader IN (SELECT a FROM l)),
c2 AS (SELECT a, b, c FROM s UNION ALL SELECT b, a, c FROM s UNION ALL SELECT id, id, 1e0 FROM k),
q AS (SELECT x.leader, sum(coalesce(c2.c, 0)) / count(*) AS mean FROM z AS x JOIN m AS mx ON mx.id = x.id JOIN z AS y ON y.leader = x.leader AND x.id < y.id JOIN m AS my ON my.id = y.id LEFT JOIN c2 ON c2.a = mx.rep AND c2.b = my.rep GROUP BY x.leader),
tf AS (SELECT z.leader, z.id AS doc_id, count(*) OVER (PARTITION BY z.leader) AS size, {r4('mean', 3)} AS similarity_score FROM z JOIN q ON q.leader = z.leader)"""


def _whole(spark, sf):
    """All documents in batches, with whole texts."""
    return table(spark, sf, "documents").select(F.floor(F.col("doc_id") / BATCH).alias("batch"), F.col("doc_id").alias("id"), "text")


@query(f"WITH {_COSINES} SELECT a, b, {r4('similarity', 6)} AS similarity FROM p")
def tfidf_pairs(spark, sf):
    return W.tfidf_pairs(_whole(spark, sf)).select("a", "b", T.rounded(F.col("similarity"), 6).alias("similarity"))


@query(f"WITH RECURSIVE {_GROUPS} SELECT * FROM tf")
def tfidf_clusters(spark, sf):
    return W.tfidf_clusters(_whole(spark, sf)).select("leader", F.col("id").alias("doc_id"), "size", "similarity_score")


@query(f"""WITH RECURSIVE {_GROUPS},
n AS (SELECT batch, id, array_to_string(list_transform(({SENTS})[1:8], lambda x: least(20, len({TOKS.format('x')}))), ',') AS shape, array_to_string(({TOKS.format('text')})[1:5], ' ') AS opening FROM {_TEXTS}),
b AS (SELECT 'structural_template' AS type, min(id) OVER k AS leader, id AS doc_id, shape AS detail, count(*) OVER k AS size FROM n WINDOW k AS (PARTITION BY batch, shape)
  UNION ALL SELECT 'repeated_opening', min(id) OVER k, id, opening, count(*) OVER k FROM n WHERE opening <> '' WINDOW k AS (PARTITION BY batch, opening))
SELECT type, leader, doc_id, detail FROM b WHERE size > 1 UNION ALL SELECT 'tfidf_similarity', leader, doc_id, format('{{:.3f}}', similarity_score) FROM tf""")
def batch_report(spark, sf):
    return W.batch_report(_whole(spark, sf)).select("type", "leader", F.col("id").alias("doc_id"), "detail")


#: No two vectors of the tables reach the usual 0.6.
_NEAR_LEAST = 0.3
_NEAR = f"""n AS (SELECT * FROM (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM (
  SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS sim FROM embeddings AS x JOIN embeddings AS y ON x.vec_id <> y.vec_id) WHERE sim >= {_NEAR_LEAST}) WHERE rank <= 15)"""


@query(f"WITH {_NEAR} SELECT a, b, CAST(rank AS INTEGER) AS rank, sim FROM n")
def vector_neighbours(spark, sf):
    return V.neighbours(table(spark, sf, "embeddings"), _NEAR_LEAST)


@query(f"""WITH RECURSIVE {_NEAR},
o AS (SELECT a, list(b ORDER BY rank) AS bs, row_number() OVER (ORDER BY a) AS r FROM n GROUP BY a),
g AS (SELECT CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS own, CAST(0 AS BIGINT) AS r
  UNION ALL SELECT CASE WHEN len(own) = 0 THEN used ELSE list_concat(used, list_append(own, leader)) END, leader, own, r
  FROM (SELECT g.used, o.a AS leader, CASE WHEN list_contains(g.used, o.a) THEN [] ELSE list_filter(o.bs, lambda b: NOT list_contains(g.used, b)) END AS own, o.r FROM g JOIN o ON o.r = g.r + 1)),
m AS (SELECT leader, unnest(own) AS vec_id FROM g WHERE len(own) > 0),
s AS (SELECT m.leader, count(*) + 1 AS size, {r4('avg(n.sim)', 3)} AS similarity_score FROM m JOIN n ON n.a = m.leader AND n.b = m.vec_id GROUP BY m.leader)
SELECT s.leader, k.vec_id, s.size, s.similarity_score FROM s JOIN (SELECT leader, vec_id FROM m UNION ALL SELECT leader, leader FROM s) AS k ON k.leader = s.leader""")
def vector_clusters(spark, sf):
    return V.vector_clusters(V.neighbours(table(spark, sf, "embeddings"), _NEAR_LEAST))
