from __future__ import annotations

import pytest
from duck import assert_same, needs_tables

from trailmill.llm import catalog


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name])
