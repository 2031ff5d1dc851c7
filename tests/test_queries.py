"""Every wide-table query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from widegrain import queries

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(found, names):
    """Rows in the order of their exact columns, then of their floats."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(r[i] for i in order) for r in found]
    return sorted(out, key=lambda r: ([str(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)]))


def same(a, b):
    def equal(x, y):
        if isinstance(x, float) or isinstance(y, float):
            return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6)
        return str(x) == str(y)

    return len(a) == len(b) and all(equal(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    sql = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert same(rows(df.collect(), df.columns), rows(sql.fetchall(), sql.columns))


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
