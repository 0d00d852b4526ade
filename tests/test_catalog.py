"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
# Two slow ones that only repeat the whole correlation; test_fusion and test_streaming cover them.
REPEATS = {"f23_modes", "t06_recomputed_campaigns", "t07_respond_loop"}


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert normal(entry.queries()[name](spark, SF).toPandas()) == normal(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - REPEATS))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).columns
