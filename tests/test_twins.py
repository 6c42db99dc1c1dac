"""Every registered query with a SQL twin gives the twin's rows; the others give rows."""

import pytest
from compare import compare, connect

from tarnwell import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name, registry.QUERIES[name], registry.TWINS.get(name))
    assert ok, message
