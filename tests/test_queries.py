from __future__ import annotations

import pytest

from docspark.plans import registry
from tests.comparing import database, same

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_oracle(spark, sf, con, name):
    same(registry.QUERIES[name](spark, sf), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_oracle_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
