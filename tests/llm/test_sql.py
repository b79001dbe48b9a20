"""Queries with SQL give the rows that DuckDB gives; all run on the smallest fixture."""

import re

import pytest

from tallyloom.llm.queries import oracle_sql, queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(name, spark, data, duck):
    same(queries()[name](spark, data), duck.sql(oracle_sql()[name]))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if re.match(r"op\d", n)) == list(range(1, 14))
    assert {n for n in queries() if not re.match(r"op\d", n)} <= set(oracle_sql())
