"""Sums over all pairs against pairs written out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import distance as D
from cohortlab.operators import pairsums
from cohortlab.plans import base, clustering


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 257])
def test_sums_against_matrices(n):
    rng = np.random.default_rng(n)
    x, w = np.round(rng.gamma(1, 1, (n, 3)), 1), rng.random((n, 4))  # rounded, so that values tie
    d, own = D.l1_matrix(x), pairsums.Manhattan(x)
    assert np.allclose(own.sums(w), d @ w) and np.allclose(own.squares(w), d**2 @ w) and np.allclose(own.squares(w, 1), d**2 @ w)
    assert np.isclose(own.widest(), d.max())
    labels = rng.integers(0, 2, (n, 3)).astype(float)
    e = D.jaccard_matrix(labels)
    assert np.allclose(pairsums.Labels(labels).sums(w), e @ w) and np.allclose(pairsums.Labels(labels).squares(w), e**2 @ w)


def test_constants_against_pairs(spark, sf):
    c = base.cells(spark, sf)
    c = c.unionByName(c.where("uid % 7 = 0").withColumn("uid", F.col("uid") + 10**9))  # equal rows
    pairs, facts = D.pair_distances(c, c, clustering.CELL, "uid", base.TYPES), pairsums.pair_facts(c, clustering.CELL, base.TYPES)
    for rule in ("max", "mean", "sd"):
        assert np.allclose(list(pairsums.constants_from(facts, rule).first()), list(D.scaling_constants(pairs, rule).first()))


def test_within_period_forms_no_pairs(spark, sf):
    plan = clustering.registry.queries["cl4_within_period"](spark, sf)._jdf.queryExecution().toString()
    assert "Join Inner" not in plan and "uid" not in plan


def test_medoid_of_equal_rows(spark, sf):
    c = base.cells(spark, sf).where("nation < 3")
    c = c.unionByName(c.withColumn("uid", F.col("uid") + 10**9)).withColumn("um", F.col("uid") % 10**9 % 5 + 1.0)
    const = (2.0, 1.5, 1.0)
    both = D.pair_distances(c, c, clustering.CELL, "uid", base.TYPES, ordered=False).join(c.select(*clustering.CELL, F.col("uid").alias("j"), "um"), [*clustering.CELL, "j"])
    q = sum([F.pow(F.lit(w) * F.col(f"d{k + 1}") / F.lit(const[k]), 2.0) for k, w in enumerate(clustering.W)], F.lit(0.0))
    cost = both.groupBy(*clustering.CELL, "i").agg(F.round(F.sum(F.col("um") * q), 6).alias("cost"))
    want = cost.groupBy(*clustering.CELL).agg(F.min(F.struct("cost", "i"))["i"].alias("medoid"))
    found = pairsums.least_cost(c, clustering.CELL, "uid", base.TYPES, "um", clustering.W, const, 6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.where("medoid >= 1000000000").count() == 0
