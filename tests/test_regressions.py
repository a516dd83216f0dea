"""Regressions of many columns by matrix products against those by aggregates."""

import numpy as np
from pyspark.sql import functions as F

from cohortlab.operators import econometrics as E


def _data(spark):
    noise = lambda s: F.randn(s)
    df = spark.range(0, 2000, 1, 3).select((F.col("id") % 90).alias("uid"), *[noise(i).alias(f"x{i}") for i in range(9)])
    return df.withColumn("y", F.col("x1") - 2 * F.col("x3") + noise(20)).localCheckpoint()


def test_many_columns_are_matrix_products(spark, monkeypatch):
    df, x = _data(spark), [f"x{i}" for i in range(9)]
    for options in ({}, {"constant": False, "extra_df": 3}):
        fits = []
        for few in (8, 100):
            monkeypatch.setattr(E, "FEW", few)
            fits.append(E.ols_clustered(df, "y", x, "uid", **options))
        a, b = fits
        assert a.names == b.names and (a.n, a.groups) == (b.n, b.groups) and np.isclose(a.adj_r2, b.adj_r2)
        assert np.allclose(a.coef, b.coef) and np.allclose(a.cov, b.cov)


def test_cross_validation_explodes_no_rows(spark, monkeypatch):
    df = _data(spark)
    monkeypatch.delattr(E, "gram")  # cross products of all folds come from one pass over the rows themselves
    got = E.grouped_cv(df, "y", {"one": ["x1"], "two": ["x1", "x3"]}, "uid", reps=3)
    assert len(got["one"]) == 3 and all(0 < a < b < 1 for a, b in zip(got["one"], got["two"]))
