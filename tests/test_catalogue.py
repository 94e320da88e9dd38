"""Every query against its SQL on the smallest tables, as the driver compares them."""

from collections import Counter

import duckdb
import pytest

from quillgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_queries_without_sql_are_those_that_sql_cannot_express():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"stemmed_vocabulary", "cycle_notes", "bm25_stemmed"}
