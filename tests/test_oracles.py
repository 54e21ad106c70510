from __future__ import annotations

import pytest
from duck import assert_same, needs_tables

from trailmill import catalog


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    from duck import SF_DIR

    df = catalog.queries()[name](spark, SF_DIR)
    assert df.count() > 0 and df.schema == catalog.queries()[name](spark, SF_DIR).schema
