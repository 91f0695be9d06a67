"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import duckdb
import pytest

from tools.check_oracle import TABLES, canon_rows

import __spark_entry__ as E

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name, sf_small):
    df = QUERIES[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert canon_rows(df.columns, rows) == canon_rows(ocols, orows)


def test_every_query_runs(spark, sf_small):
    for name, fn in QUERIES.items():
        if name not in ORACLE:
            fn(spark, sf_small).limit(5).collect()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
