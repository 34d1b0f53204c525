from __future__ import annotations

import pytest
from oracle import duck_rows, spark_rows

from loomwork.plans.queries import QUERIES
from loomwork.plans.sql import ORACLES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(sf_dir, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and {"model", "task_type", "is_total", "correct", "total", "winner"} == set(rows[0].asDict())
    assert set(entry.oracle_sql()) <= set(entry.queries())
