"""Every query with oracle SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from textloom.plans import builder_queries, change_queries, cluster_queries, domain_queries, ingest_queries, reasoning_queries, score_sql, stance_queries, training_queries  # noqa: F401 - they register their queries
from textloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(columns).collect())
    assert len(set(columns)) == len(columns)
    if name in ORACLES:
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    else:
        assert got
