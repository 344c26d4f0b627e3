"""The subpackage's SQL is SQL."""

from gridloom.llm import queries


def test_sql_is_text():
    assert all(isinstance(x, str) for x in queries.oracle_sql().values())
