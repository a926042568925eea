"""The training-data queries against their DuckDB statements on the smallest tables."""

import os

import pytest

from leafmill.llm.queries import QUERIES
from leafmill.llm.sql import ORACLE
from tests.engine.test_registered import SF, rows, tables  # noqa: F401  (a fixture)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_statement(spark, tables, name):  # noqa: F811
    got, want = QUERIES[name](spark, SF).toPandas(), tables.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_everything_is_registered():
    import __spark_entry__ as entry

    assert len([q for q in entry.queries() if q.startswith("op")]) == 10 and "pipeline" in entry.queries() and set(ORACLE) <= set(entry.oracle_sql())
