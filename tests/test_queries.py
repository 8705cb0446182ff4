"""Every query with an SQL twin gives the twin's rows; the others give rows."""

import pytest
from compare import check, connect

from __spark_entry__ import entry, oracle_sql, queries

# uncertainty_votes, oos_rows, margin_parts, test_learning.py and test_boosting.py stand for them
HEAVY = {"uncertainty_rounds", "random_search", "margin_attribution"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, folder, name):
    text, _, fine = check(spark, con, folder, name, oracle_sql()[name])
    assert fine, text


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - HEAVY))
def test_gives_rows(spark, folder, name):
    assert queries()[name](spark, folder).count() > 0


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
