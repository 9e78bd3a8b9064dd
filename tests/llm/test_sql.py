"""Every query with SQL gives DuckDB's rows on sf0.001, types included."""
import duckdb
import pytest

from cohort_engine.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = Q.queries()[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(Q.oracle_sql()[name])
    want = plain(rel.fetchall(), [d[0] for d in rel.description])
    assert sorted(df.columns) == sorted(d[0] for d in rel.description)
    assert got == want and got


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in Q.queries()
