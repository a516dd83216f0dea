"""Settings compared without a table of memberships, against the way with one."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import econometrics as E
from cohortlab.operators import settings as S
from cohortlab.operators.align import optimal_assignment
from cohortlab.plans import clustering, inference
from cohortlab.sources import io

SETTINGS = {"a": ("shrunk", replace(inference.MAIN, k=3, starts=3)), "b": ("raw", replace(inference.MAIN, m=1.5, starts=2))}


def test_results_are_those_of_a_table_of_memberships(spark):
    sf, added = "/root/testdata/sf0.01", ("du", "norm", "levels")
    found, facts = inference.evaluate(spark, sf, SETTINGS, added, ("core",), reps=2)
    base = clustering.both_rates(spark, sf)
    aligned = inference.aligned_configs(base, clustering.fit_configs(base, SETTINGS))
    moves = io.staged(inference.changes(aligned, ["config", "uid"]), "changes")
    data = io.staged(inference.design_of(base, inference._SHRUNK_STATS).join(moves, ["uid", "season"]), "pairs")

    def specs(key, total, names):
        b = inference.blocks_of(total, names, SETTINGS[key][1].k, SETTINGS[key][0])
        return {f"core + {a}": (b["core"], b[a]) for a in added}

    want = E.nested_models(data, "config", [*inference._ALL_STATS, *inference._MOVES], "y", "uid", specs, reps=2)
    assert len(found) == len(want) == 6
    for x, z in zip(found, want):
        assert (x.key, x.model, x.n, x.entities, x.added, x.share_better) == (z.key, z.model, z.n, z.entities, z.added, z.share_better)
        assert np.allclose([x.adj_r2_base, x.adj_r2_ext, x.wald_p, x.oos_base, x.oos_ext], [z.adj_r2_base, z.adj_r2_ext, z.wald_p, z.oos_base, z.oos_ext]) and np.allclose(x.coef, z.coef) and np.allclose(x.se, z.se)
    same = {r["config"]: r["p"] for r in moves.groupBy("config").agg({"same": "avg"}).withColumnRenamed("avg(same)", "p").collect()}
    assert {f["config"]: round(f["persistence"], 9) for f in facts} == {c: round(p, 9) for c, p in same.items()}


@pytest.mark.parametrize("query", ["ec18_specification_grid", "ec20_sensitivity", "ec19_seed_study", "ec22_restricted_grid", "ec9_coefficient_table", "ec7_nested_models", "ec10_minimal_baseline"])
def test_no_table_of_rows_and_settings_is_written(spark, sf, monkeypatch, query):
    written, whole = [], inference.specification_grid()
    monkeypatch.setattr(inference, "specification_grid", lambda: dict(list(whole.items())[:12]))  # some of the settings, for time

    def keep(df, name):
        written.append(name)
        assert not {"config", "uid"} <= set(df.columns)
        return io.staged(df, name)

    for module in (inference, clustering, S):
        monkeypatch.setattr(module, "staged", keep)
    assert inference.registry.queries[query](spark, sf).count() > 0 and "fits" in written and "pairs" in written


def test_permutations_are_those_of_the_table_of_costs(spark):
    costs = np.round(np.random.default_rng(0).random((40, 3, 3)), 1)  # rounded, so that totals tie
    rows = [(g, a + 1, b + 1, float(costs[g, a, b])) for g in range(40) for a in range(3) for b in range(3)]
    want = {(r["g"], r["a"]): r["b"] for r in optimal_assignment(spark.createDataFrame(rows, "g int, a int, b int, cost double"), ["g"], 3).collect()}
    found = S.best_permutations(costs)
    assert want == {(g, a + 1): int(found[g, a]) + 1 for g in range(40) for a in range(3)}


def test_rows_without_a_cell_and_cells_too_small(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    assert inference.evaluate(spark, sf, {"large": ("raw", replace(inference.MAIN, k=10**6, starts=1))}, reps=0) == ([], [])
    base = clustering.both_rates(spark, sf)
    monkeypatch.setattr(inference, "both_rates", lambda spark, sf: base.withColumn("nation", F.when(F.col("uid") % 5 > 0, F.col("nation"))))
    found, facts = inference.evaluate(spark, sf, {"a": ("raw", replace(inference.MAIN, starts=1))}, reps=0)
    pairs = inference.design_of(base.where("uid % 5 > 0"), inference._SHRUNK_STATS).count()
    assert [x.n for x in found] == [pairs, pairs] and 0 < facts[0]["persistence"] < 1
