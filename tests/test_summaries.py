"""Queries on whole fits take what they need of each cell; against the rows of members that `fit_cells` gives, which they no longer make."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.operators import fcm
from cohortlab.operators import panel as P
from cohortlab.plans import base, clustering
from cohortlab.plans.clustering import CELL, MAIN, PLAIN, RATES


@pytest.fixture
def run(spark, monkeypatch):
    """A query's rows, with `fit_cells` out of reach."""

    def go(name):
        with monkeypatch.context() as m:
            m.setattr(fcm, "fit_cells", None)
            return clustering.registry.queries[name](spark, SF).collect()

    return go


SF = "/root/testdata/sf0.01"


def _members(spark, rates):
    found = clustering.both_rates(spark, SF)
    configs = {f"{rates}_rho{rho}_k{k}": replace(MAIN, k=k, rho=rho) for rho in (0.5, 1.0) for k in range(2, 8)}
    one = found.where("season = 1998")
    return one, fcm.fit_cells(one, CELL, "uid", RATES[rates], configs, clustering.constants_of(found, rates)).localCheckpoint()


def _close(a, b):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, float) and np.isclose(u, v, rtol=1e-4, equal_nan=True)) for u, v in zip(x, y)), (x, y)


def test_profiles(spark, run):
    one, found = _members(spark, "shrunk")
    some = found.where("config like 'shrunk_rho1.0_k%' and k between 3 and 5")
    long = some.join(one.select(*CELL, "uid", *PLAIN), [*CELL, "uid"]).select("config", "hard", *PLAIN, F.posexplode("u").alias("c", "w"))
    want = long.groupBy("config", F.col("c") + 1).agg(F.sum((F.col("hard") == F.col("c") + 1).cast("long")), F.sum("w"), *[F.sum(F.col("w") * F.col(c)) / F.sum("w") for c in PLAIN]).collect()
    got = run("cl21_profiles")
    total = lambda rows, noise: {c: sum(x[2] for x in rows if x[0] == c and (x[1] > int(c[-1])) == noise) for c in {x[0] for x in rows}}
    assert len(got) == len(want) == 15
    for noise in (False, True):  # starts that tie may give a cell's clusters in another order
        assert total(got, noise) == total(want, noise)
    _close(sorted((x[0], *x[3:]) for x in got if x[1] > int(x[0][-1])), sorted((x[0], *x[4:]) for x in want if x[1] > int(x[0][-1])))


def test_medians_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(x) if i % 3 else None, float(i // 40), float("nan") if i == 7 else 1.0) for i, x in enumerate(rng.gamma(1, 1, 5000))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    for near in (1e-3, 0.2):
        got = P.pooled_medians(df, ["a", "b", "c", "d"], near)
        assert got == {c: float(np.median([r[i] for r in rows if r[i] is not None and r[i] == r[i]])) for i, c in enumerate("abcd")}


def test_scales_count_rows_once_and_cells_join_customers(spark, tmp_path, monkeypatch):
    """A customer listed twice gives two rows of the cells, one that is missing none; the scales are those of the sample in either case."""
    real = base.table
    customers = real(spark, SF, "customer")
    odd = customers.where("c_custkey % 5 > 0").unionByName(customers.where("c_custkey % 7 = 0"))
    monkeypatch.setattr(base, "table", lambda spark, sf, name: odd if name == "customer" else real(spark, sf, name))
    scaled = P.add_scaled(base.exposed(base.flagged_panel(spark, SF)), base.SCALED)
    want = scaled.join(odd.select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("nation")), "uid")
    names = ["uid", "season", *base.TYPES.columns, "nation"]
    for got in (base.cells(spark, SF, columns=["season", *base.TYPES.columns]), clustering.both_rates(spark, SF)):
        _close(sorted(map(tuple, got.select(names).collect())), sorted(map(tuple, want.select(names).collect())))


def test_parameter_grid(spark, run):
    configs = {f"k{k}_m{m}": replace(MAIN, k=k, m=m) for k in (2, 3, 4, 5, 6) for m in (1.2, 1.3, 1.4, 1.5)}
    want = fcm.fit_diagnostics(clustering.fits(spark, SF, configs).localCheckpoint(), CELL)
    _close(sorted(map(tuple, run("cl19_parameter_grid"))), sorted(map(tuple, want.collect())))


def _both(spark):
    return clustering._single_period(spark, SF, fcm.fit_cells).localCheckpoint()


def test_rows_of_most_noise(spark, run):
    noise = _both(spark).withColumn("u_noise", F.element_at("u", -1))
    top = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("u_noise"), "nation", "uid"))
    want = noise.withColumn("place", top).where("place <= 5").select("config", "place", "nation", "uid", "u_noise").collect()
    _close(sorted(map(tuple, run("cl21_single_period"))), sorted((*x[:4], round(x[4], 6)) for x in want))


def test_single_period_grid(spark, run):
    _close(sorted(map(tuple, run("cl21_grid"))), sorted(map(tuple, fcm.fit_diagnostics(_both(spark), CELL).collect())))


def test_estimated_weights(spark, run):
    found = clustering.both_rates(spark, SF)
    configs = {f"max_raw_k{k}": replace(MAIN, k=k, rho=0.5, weights=None) for k in (3, 4, 5)}
    rows = fcm.fit_cells(found.where("season = 2000"), CELL, "uid", RATES["raw"], configs, clustering.constants_of(found, "raw", "max"))
    share = F.avg((F.col("hard") == F.col("k") + 1).cast("double"))
    want = rows.groupBy(*CELL, "config").agg(F.first("weights"), share, F.first("xie_beni"), F.first("degenerate")).collect()
    got = [x for x in run("cl22_estimated_weights") if x["config"].startswith("max_raw")]
    _close(sorted(map(tuple, got)), sorted((*x[:3], *x[3], *x[4:]) for x in want))
