import pytest

from strandloom.plans import design_queries, figure_queries, flow_queries, genome_queries, problem_queries, stat_queries, table_queries, variant_queries

MODULES = (problem_queries, table_queries, stat_queries, genome_queries, design_queries, flow_queries, variant_queries, figure_queries)
WITH_SQL = [(m.registry, n) for m in MODULES for n in m.registry.queries if n in m.registry.sql]
WITHOUT = [(m.registry, n) for m in MODULES for n in m.registry.queries if n not in m.registry.sql]


@pytest.mark.parametrize(("registry", "name"), WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_same_as_sql(same, registry, name):
    same(registry, name)


@pytest.mark.parametrize(("registry", "name"), WITHOUT, ids=[n for _, n in WITHOUT])
def test_runs_and_repeats(spark, rows, registry, name):
    from tests.conftest import DATA

    first = registry.queries[name](spark, str(DATA))
    assert first.columns
    assert rows(first) == rows(registry.queries[name](spark, str(DATA)))


def test_names_are_unique():
    names = [n for m in MODULES for n in m.registry.queries]
    assert len(names) == len(set(names))
