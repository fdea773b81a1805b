"""Every registered query against its SQL, on the small tables."""

import oracle
import pytest

from eraloom.catalog import registry

REGISTRY = registry()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_matches_sql(spark, sf_dir, con, name):
    query, sql = REGISTRY[name]
    note = oracle.compare(query(spark, sf_dir), con, sql)
    # Some findings cannot occur in the smallest tables; both sides must agree on that too.
    assert note in ("", "no rows"), note


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_runs_without_sql(spark, sf_dir, name):
    assert REGISTRY[name][0](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
