"""What the clustering queries write between their steps."""

import pytest

from cohortlab.plans import base, catalog, clustering
from cohortlab.sources import io


@pytest.fixture
def written(monkeypatch):
    """(name, columns) of every staged table."""
    seen = []

    def keep(df, name):
        seen.append((name, set(df.columns)))
        return io.staged(df, name)

    for module in (base, clustering):
        monkeypatch.setattr(module, "staged", keep)
    return seen


@pytest.mark.parametrize("name", ["cl13_fit", "cl17_best_of_starts", "cl12_medoid_update"])
def test_only_what_a_fit_reads_is_written(spark, sf, written, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
    assert [n for n, _ in written] == ["sample", "cells"] and all("value" not in columns and "ppm" not in columns for _, columns in written)
