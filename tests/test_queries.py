"""Every registered query of the core that has SQL has its columns and rows on the given tables; the others have tests of their own."""

import pytest

import __spark_entry__ as entry
from reportmill import plans

duckdb = pytest.importorskip("duckdb")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def compared(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    shown = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    want = sorted(tuple(shown(r[at[c]]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(shown(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_as_sql(spark, sf_dir, name):
    compared(spark, sf_dir, plans.QUERIES[name], plans.SQL[name])


def test_entry(spark):
    assert [r.prompt_condition for r in entry.entry(spark).collect()] == ["cot", "ddx", "direct", "evidence_first", "uncertainty_first"]


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
