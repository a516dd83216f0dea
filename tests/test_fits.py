"""Fits over distinct rows and of several settings at once, against fits of whole matrices one by one."""

from dataclasses import replace

import numpy as np

from cohortlab.operators import distance as D
from cohortlab.operators import fcm

TYPES, CONSTANTS = D.Types(("a", "b"), ("c",), ("p", "q")), (2.0, 1.5, 1.0)


def _cell(rng, n, times):
    x = {c: rng.gamma(1, 1, n) for c in "abc"} | {c: rng.integers(0, 2, n).astype(float) for c in "pq"}
    order = rng.permutation(n * times)
    return {c: np.tile(v, times)[order] for c, v in x.items()}


def _matrices(x):
    return fcm.Distances(len(x["a"]), [d**2 for d in D.cell_matrices(x, TYPES, CONSTANTS)])


def test_equal_rows_count_as_often_as_they_occur():
    rng = np.random.default_rng(0)
    x = _cell(rng, 30, 4)
    for weights in ((0.4, 0.3, 0.3), None):
        config = fcm.FitConfig(k=3, starts=4, weights=weights)
        want = fcm.fit_best(_matrices(x), config)
        for most in (1000, 0):  # as matrices, and as sums from sorted orders
            own = fcm.Distances.of(x, TYPES, CONSTANTS, most)
            fit = fcm.fit_best(own, config)
            assert len(own.first) == 30 and fit.medoids == want.medoids and np.allclose(fit.u, want.u)
            assert np.isclose(fit.objective, want.objective) and np.isclose(fit.xie_beni, want.xie_beni) and np.isclose(fit.stability, want.stability)
            assert fcm.degenerate(fit) == fcm.degenerate(want)


def test_copies_can_be_medoids_of_two_clusters():
    x = {c: np.repeat([0.0, 5.0], 3) for c in "abc"} | {c: np.zeros(6) for c in "pq"}
    for k in (3, 4, 5):
        fit, want = (fcm.fit_best(d, fcm.FitConfig(k=k, starts=3, weights=(0.4, 0.3, 0.3))) for d in (fcm.Distances.of(x, TYPES, CONSTANTS), _matrices(x)))
        assert fit.medoids == want.medoids and len(set(fit.medoids)) == k and np.allclose(fit.u, want.u)


def test_settings_side_by_side_are_those_one_by_one():
    x = _cell(np.random.default_rng(1), 80, 1)
    configs = [fcm.FitConfig(k=k, m=m, rho=rho, starts=3, seed=s, weights=(0.4, 0.3, 0.3)) for k in (2, 4) for m in (1.3, 2.0) for rho in (0.5, 1.5) for s in (0, 100)]
    configs += [replace(configs[0], weights=None), replace(configs[1], noise_rule="weighted")]
    for c, fit in zip(configs, fcm._best(fcm.Distances.of(x, TYPES, CONSTANTS), configs)):
        want = fcm.fit_best(_matrices(x), c)
        assert fit.medoids == want.medoids and np.isclose(fit.objective, want.objective) and fit.rounds == want.rounds
