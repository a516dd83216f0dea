"""Every registered query of the panel engine against its SQL on DuckDB, or for rows where SQL can't express it."""

import pytest

from cohortlab.plans import catalog, inference

from .oracle import connect, difference


@pytest.fixture(autouse=True)
def fewer_replicates(monkeypatch):
    """The bootstrap queries run whole, but for the number of replicates."""
    monkeypatch.setattr(inference, "REPLICATES", 12)



@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL)))
def test_against_sql(spark, sf, con, name):
    assert difference(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, sf, name):
    larger = "/root/testdata/sf0.01"  # where the smallest tables hold no match
    assert catalog.QUERIES[name](spark, larger if name.startswith("jn7") else sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
