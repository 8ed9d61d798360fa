"""Every query with SQL gives the rows that DuckDB gives; every query of a datatype agrees with its Python check."""

import os

import duckdb
import pytest

from treegrammar.plans import catalogue, document_queries, schema_queries, tree_queries

MODULES = (catalogue, schema_queries, tree_queries, document_queries)
QUERIES, ORACLES = {k: q for m in MODULES for k, q in m.QUERIES.items()}, {k: s for m in MODULES for k, s in m.ORACLES.items()}

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = want.fetchall()
    assert rows and sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
