"""Every registered query against its SQL on the raw tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from domloom.plans.oracles import all_oracles
from domloom.plans.queries import all_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
# The queries of the optional subpackage have tests of their own.
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    names = sorted(columns)
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    b = sorted((tuple(r[columns.index(c)] for c in names) for r in want.fetchall()), key=str)
    assert a == b


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["page_id", "section", "is_list", "value", "values", "source_xpath"]
    assert result.count() == 200
