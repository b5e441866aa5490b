"""Every registered query of the library runs, and those with SQL agree with DuckDB."""

from __future__ import annotations

import pytest
from compare import rows

from citespark.plans import queries

WITHOUT_SQL = {"parse_ref_text", "source_records"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in WITHOUT_SQL:
        assert name not in queries.ORACLE_SQL and len(got)
        return
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["source", "target", "weight"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_stays_in_the_jvm(spark, data):
    plan = queries.QUERIES[queries.FLAGSHIP](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
