"""Every registered query against its DuckDB oracle SQL on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from ratebook.sources.standin import TABLES
from tools.check_oracle import rows_key

from .conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()
SLOW = {"additive_fit"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 13


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows, scols = [tuple(r) for r in sdf.collect()], sdf.columns
    cur = duck.execute(ORACLE[name])
    drows, dcols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_key(srows, scols) == rows_key(drows, dcols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0
