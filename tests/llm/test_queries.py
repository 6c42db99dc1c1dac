"""Queries against their SQL on a small scale, and the entry points."""

import __spark_entry__ as entry
import pytest
from compare import compare, connect

from tarnwell.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.TWINS))
def test_same_rows_as_sql(spark, name):
    ok, message = compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.TWINS[name])
    assert ok, message


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert "pipeline" in names
