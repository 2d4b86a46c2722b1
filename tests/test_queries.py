"""Every registered query against its SQL, over whole tables."""

import math

import pytest
from conftest import TESTDATA

import __spark_entry__ as contract
from wordwood.plans import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL = ORACLE_SQL


@pytest.fixture(scope="module")
def tables():
    path = TESTDATA / "sf0.01"
    if not path.exists():
        pytest.skip(f"no test tables at {path}")
    return str(path)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return con


def rows(columns, records):
    """Rows as sorted tuples, columns in order of their names; floats to 9 digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, result.fetchall())
    assert len(got) == len(want) > 0
    assert got == want


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["word", "n"]
    assert contract.entry(spark).count() == 10
