"""Every registered query with SQL gives what the SQL gives, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_same_rows(spark, con, name):
    assert difference(name, queries()[name](spark, SF_DIR), con, SQLS[name]) in (None, "(no rows)")


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQLS)))
def test_some_rows(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert set(entry(spark).columns) == {"doc_id", "labels", "feature_len", "part"}
