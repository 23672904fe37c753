"""Every registered market, research and document query against its SQL, or for its rows where it has none."""

import os

import pytest
from oracle import assert_same, connect

from strandline.plans import books, common, documents, keyed, market, more, research, windows  # noqa: F401


#: The smallest scale at which every query has rows: daily grids must fill their windows.
DATA = os.environ.get("TEST_QUERY_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def data_dir():
    return DATA


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(common.ORACLES))
def test_against_sql(spark, data_dir, con, name):
    rows = common.QUERIES[name](spark, data_dir).toPandas()
    assert_same(rows, con.sql(common.ORACLES[name]).df())
    assert len(rows) > 0, "nothing was compared"


@pytest.mark.parametrize("name", sorted(set(common.QUERIES) - set(common.ORACLES)))
def test_runs(spark, data_dir, name):
    """No SQL form: whole rows, no column without a value, and the same rows again. Values are tested in test_operators."""
    rows = common.QUERIES[name](spark, data_dir).toPandas()
    assert len(rows) > 0 and not rows.isna().all().any()
    again = common.QUERIES[name](spark, data_dir).toPandas()
    assert_same(rows, again)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
