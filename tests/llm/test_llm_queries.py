import pytest

from strandloom.llm.queries import registry


@pytest.mark.parametrize("name", list(registry.sql))
def test_same_as_sql(same, name):
    same(registry, name)


@pytest.mark.parametrize("name", [n for n in registry.queries if n not in registry.sql])
def test_repeats(spark, rows, name):
    from tests.conftest import DATA

    first = registry.queries[name](spark, str(DATA))
    assert rows(first) == rows(registry.queries[name](spark, str(DATA)))
