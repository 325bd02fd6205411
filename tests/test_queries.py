"""Every named query against its DuckDB SQL on the same tables."""

from __future__ import annotations

import pytest
from conftest import rows

from corvane.plans import catalogue

WITHOUT_SQL = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, duck, name):
    found, wanted = catalogue.QUERIES[name](spark, sf), duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    found = rows(found)
    assert found == rows(wanted)
    assert found, "a query without rows shows nothing"


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert set(out.columns) == {"query_id", "id", "rank", "score", "filename", "passage"} and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
