"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()
MODELS = ("rf_classify", "rf_regress", "out_of_fold", "grid_search")


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, connection, folder, name):
    extra, missing, rows = differences(spark, connection, folder, QUERIES[name], SQL[name])
    assert (extra, missing) == ({}, {})
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", MODELS)
def test_models_run(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_random_split_is_repeatable_and_near_its_share(spark, folder):
    rows = QUERIES["random_split"](spark, folder)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert 0.15 < counts["test"] / sum(counts.values()) < 0.25
    again = QUERIES["random_split"](spark, folder).repartition(5)
    assert rows.exceptAll(again).isEmpty()
