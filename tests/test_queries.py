import functools

import pytest

import __spark_entry__ as entry

from .oracle import connection, same

from wordloom.plans import associations, models, shapes, soft
from wordloom.plans.registry import QUERIES, SQL


@pytest.fixture(autouse=True, scope="module")
def shared_tables():
    """Queries over one profile or model share its stored tables here, which each makes for itself otherwise."""
    with pytest.MonkeyPatch.context() as patch:
        for name, modules in (("_profile", (associations, shapes)), ("_model", (soft,)), ("_soft", (soft, models))):
            once = functools.cache(getattr(modules[0], name))
            for module in modules:
                patch.setattr(module, name, once)
        yield


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    same(QUERIES[name](spark, small), connection(small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
