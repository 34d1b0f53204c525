from __future__ import annotations

import pytest
from oracle import duck_rows, spark_rows

from loomwork.llm.queries import queries
from loomwork.llm.sql import oracle_sql


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert spark_rows(queries()[name](spark, sf_dir)) == duck_rows(sf_dir, oracle_sql()[name])


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 14))
