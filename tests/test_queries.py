"""Every registered ledger query against its SQL."""

from __future__ import annotations

import pytest
from conftest import same_rows

import ledgerloom.integrity_queries  # noqa: F401  (these add their queries)
import ledgerloom.plan_queries  # noqa: F401
import ledgerloom.release_queries  # noqa: F401
from ledgerloom.catalog_queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        same_rows(df, duck.execute(ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_scan_is_pruned(spark, sf_dir):
    """Filters and columns reach the scan."""
    plan = QUERIES["semi_exists"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
