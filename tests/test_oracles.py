"""Every core query against its SQL twin."""

import pytest

from loomgraph.plans import load_core

CORE = load_core()


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(CORE.queries[name], CORE.sql[name])


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(CORE.queries) - set(CORE.sql)):
        assert CORE.queries[name](spark, "/root/testdata/sf0.001").count() >= 0, name
