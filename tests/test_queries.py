"""Every registered query against its SQL twin in DuckDB."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from skyledger.plans.queries import ORACLES, QUERIES
from tools.compare import TABLES, canonical_rows


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = canonical_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == canonical_rows(columns, cur.fetchall())


def test_entry_is_complete(spark):
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    rows = {r["fold"]: r for r in entry(spark).collect()}
    assert set(rows) == {"all", "A", "B"}
    assert rows["all"]["n_total"] == rows["A"]["n_total"] + rows["B"]["n_total"]
