"""Every query of the entry module that has SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from frameflow.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def rows(frame, columns):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None)))


def against_sql(spark, query, sql):
    connection = duckdb.connect()
    for f in Path(SF).iterdir():
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    wanted, found = connection.execute(sql).df(), query(spark, SF).toPandas()
    assert sorted(wanted.columns) == sorted(found.columns)
    columns = sorted(found.columns)
    assert rows(found, columns) == rows(wanted, columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    against_sql(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
