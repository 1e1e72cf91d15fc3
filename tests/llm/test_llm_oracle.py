"""Queries of the subpackage that SQL can express, against DuckDB; and that all others run."""

from __future__ import annotations

import pytest
from compare import agree, connection

from quire.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    agree(spark, connection(FOLDER), queries.queries()[name], queries.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["work_id", "ref_id"]), ("p3_found", ["field", "id_a", "id_b"]), ("p4_found", ["field", "row_id", "lang"]), ("p6_found", ["field", "row_id", "noise"]), ("p7_found", ["name_a", "name_b"]), ("p9_found", ["item_id", "doc_id"]), ("p10_found", ["doc_id"])])
def test_found_has_its_columns(spark, name, columns):
    df = queries.queries()[name](spark, FOLDER)
    assert df.columns == columns
    rows = df.collect()
    assert len(rows) == len(set(rows))
