"""The queries of this folder against their SQL, over whole tables."""

import os

import pytest
from conftest import TESTDATA
from test_queries import TABLES, rows

import __spark_entry__ as contract
from wordwood.llm.oracle import LLM_ORACLE
from wordwood.llm.queries import LLM_QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables():
    path = TESTDATA / "sf0.01"
    if not path.exists():
        pytest.skip(f"no test tables at {path}")
    return str(path)


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_equals_sql(spark, tables, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, tables)
    result = con.execute(LLM_ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, result.fetchall())
    assert len(got) == len(want) > 0
    assert got == want


def test_all_are_registered():
    names = contract.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_ORACLE)))
def test_one_row_per_row(spark, sf_dir, name):
    table = {"op1": "pages", "op12": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
    # A conversation has several rows.
    want = rows.select("conv_id").distinct().count() if table == "conversations" else rows.count()
    assert LLM_QUERIES[name](spark, sf_dir).count() == want
