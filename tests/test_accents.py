"""Queries against their SQL on texts whose words end before, behind or at letters beyond ASCII."""

import random

import duckdb
import pytest

from textloom.plans import change_queries, domain_queries  # noqa: F401 - they register their queries
from textloom.plans.queries import ORACLES, QUERIES

WORDS = (
    "improved performance several issues because that was slow slow which profiling showed 40 users test chose some users in certain cases better design 12 350 2021 40% role team "
    "experience skill i am look forward thank Ana Lopez NASA must proven case study API/Url source lgtm temp todo will noted def fixed quickly and delve into AI-powered scalable p95 reduced by 40 Redis pool_size"
).split()
ACCENTS = "éñßÉêx"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(4)
    near = lambda w: draw.choice([w, w, w + draw.choice(ACCENTS), draw.choice(ACCENTS) + w, w.capitalize() + draw.choice(ACCENTS) + w.capitalize(), f"({w.capitalize()}é, 2021)"])
    text = lambda: "".join(" ".join(near(draw.choice(WORDS)) for _ in range(draw.randrange(1, 14))) + draw.choice([". ", "! ", " because ", " that ", ", "]) for _ in range(5))
    path = tmp_path_factory.mktemp("accents")
    rows = [(i, text(), "en", "src1") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["domain_signals", "docs_signals", "academia_signals", "code_review_signals", "improvement_hints", "improvement_summary", "sig_evidence_density", "sig_specificity", "sig_information_density"])
def test_accents(spark, folder, name):
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    shown = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)
    got = sorted(tuple(map(shown, r)) for r in df.select(columns).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cur.fetchall()) and got
