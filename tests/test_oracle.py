"""Every core query with SQL against DuckDB."""

from __future__ import annotations

import pytest
from compare import agree, connection

from quire.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    agree(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], FOLDER)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
