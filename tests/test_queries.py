"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from check import TABLES, tidy  # noqa: E402

ROOT = "/root/testdata/sf0.001"
QUICK = ["pairs_within", "interfaces", "runs", "nearest_label", "pair_places", "pseudoknots", "outcomes", "moved", "stratified_draw", "hash_split", "stream_outcomes", "quartiles", "bridges"]
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, con, name):
    got = tidy(queries()[name](spark, ROOT).toPandas())
    want = tidy(con.execute(oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_rings_over_all_lines_equal_the_sql_without_its_filter(spark, con):
    sql = oracle_sql()["g_tetrads"]
    whole = sql.replace(" WHERE l_quantity >= 40", "")
    assert whole != sql
    got = queries()["rings_of_four"](spark, ROOT)
    mine = {tuple(r) for r in got.toPandas()["ring"]}
    want = {tuple(r[0]) for r in con.execute(whole).fetchall()}
    assert len(want) > 500_000 and mine == want
