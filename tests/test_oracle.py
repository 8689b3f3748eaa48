"""Every engine query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from flowframe.oracle import ORACLE_SQL
from flowframe.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    def rows(table):
        cells = [table.column(c).to_pylist() for c in sorted(table.column_names)]
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in zip(*cells)), key=repr)

    got = QUERIES[name](spark, SF).toArrow()
    want = duck.execute(ORACLE_SQL[name]).to_arrow_table() if hasattr(duck, "to_arrow_table") else duck.execute(ORACLE_SQL[name]).fetch_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
