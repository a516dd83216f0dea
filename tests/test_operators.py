import datetime
import difflib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import special, strings, vectors
from cohortlab.operators import align, contracts, distance, econometrics, fcm, linkage, panel, quantiles, resample, textdiff
from cohortlab.sources import io


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# -- functions ---------------------------------------------------------------------------------------------------------------------


def test_names_and_ratios(spark):
    df = spark.createDataFrame([("Łukasz  Ståhl-Ærø",), ("Jürgen Groß",), ("O'Ñeil",), (None,)], "s string")
    assert [r[0] for r in df.select(strings.normalize_name(F.col("s"))).collect()] == ["lukasz stahl aero", "jurgen gross", "o neil", None]
    assert strings.sort_ratio("b a", "a b") == 100 and strings.set_ratio("a b", "a b c d") == 100 and strings.set_ratio("", "a") == 0
    assert math.isclose(strings.ratio("abcd", "abxd"), 75.0) and strings.ratio("", "") == 100
    for a, b in (("kitten", "sitting"), ("abcabba", "cbabac")):
        lcs = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert strings._common(a, b) >= lcs
    two = spark.createDataFrame([("ann lee", "lee ann"), (None, "x")], "a string, b string")
    assert [r[0] for r in two.select(strings.token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [100.0, None]


def test_tails():
    assert math.isclose(special.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-12)
    assert math.isclose(special.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(special.chi2_tail(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(special.f_tail(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9) and math.isclose(special.f_tail(2.71, 5, 20), 0.0500, rel_tol=2e-3)
    assert special.chi2_tail(0, 3) == 1 and special.f_tail(0, 2, 3) == 1
    assert special.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert special.holm([0.0116] + [0.5] * 9)[0] == pytest.approx(0.116)


def test_vectors(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0],)], "u array<double>")
    h, top, n = df.select(vectors.entropy(F.col("u")), vectors.first_max(F.col("u")), vectors.norm2(F.col("u"))).first()
    assert math.isclose(h, math.log(2), rel_tol=1e-9) and top == 1 and math.isclose(n, math.sqrt(0.5))


# -- contracts ---------------------------------------------------------------------------------------------------------------------


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert contracts.checked_join(a, b, ["k"], validate="1:1").count() == 1 and contracts.checked_join(a, b, ["k"], validate="1:1", null_safe=True).count() == 2
    with pytest.raises(contracts.CardinalityError):
        contracts.checked_join(a, b.unionAll(b), ["k"], validate="m:1")


def test_keys_and_sets(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, v int")
    kept, bad = contracts.drop_ambiguous(df, ["k"])
    assert values(kept, "k") == [(2,)] and values(bad, "k", "rows") == [(1, 2)]
    assert values(contracts.keep_best(df, ["k"], [F.desc("v")]).orderBy("k"), "v") == [(2,), (3,)]
    up = contracts.upsert(df, spark.createDataFrame([(2, "z")], "k int, w string"), ["k"])
    assert sorted(values(up, "k", "v", "w"), key=str) == sorted([(1, 1, None), (1, 2, None), (2, None, "z")], key=str)
    with pytest.raises(Exception, match="more than one"):
        contracts.exactly_one(df, F.col("v") < 3, ["k"]).collect()


# -- panel -------------------------------------------------------------------------------------------------------------------------


def test_merge_and_ties(spark):
    rows = [(1, 9, "b", 10.0, None, "F,D", None), (1, 9, "a", 10.0, 3.0, "D, M", 2.0), (2, 9, "a", None, None, "", 1.0)]
    df = spark.createDataFrame(rows, "uid int, season int, club string, minutes double, shots double, pos string, ppm double")
    out = {r["uid"]: r for r in panel.merge_sources(df, ["uid", "season"], ["minutes", "shots"], "club", "minutes", "pos", "ppm").collect()}
    assert (out[1]["minutes"], out[1]["shots"], out[1]["club_main"], out[1]["n_clubs"], out[1]["pos"], out[1]["ppm"]) == (20.0, 3.0, "a", 2, "D,F,M", 2.0)
    assert out[2]["minutes"] is None and out[2]["shots"] is None and out[2]["ppm"] is None


def test_ratios_and_codes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None)], "s double, a double")
    assert [r[0] for r in df.select(panel.guarded_ratio(F.col("s"), F.col("a"))).collect()] == [0.5, 0.0, None]
    assert [r[0] for r in df.select(panel.rate(F.col("s"), F.col("a"))).collect()] == [45.0, None, None]
    codes = spark.createDataFrame([("98",), ("12345",), ("x1",)], "c string")
    assert values(codes.select(panel.season_code(F.col("c")).alias("c"), panel.number("c").alias("n")), "c", "n") == [("0098", 98.0), ("12345", 12345.0), ("00x1", None)]


def test_gaps_and_scale(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (1, 4, 7.0), (2, 1, 1.0)], "e int, t int, x double")
    led = {(r["e"], r["t"]): r for r in panel.gap_aware_lead(df, "e", "t", ["x"]).collect()}
    assert led[1, 1]["x_next"] == 6.0 and led[1, 2]["x_next"] is None and not led[2, 1]["has_next"]
    assert panel.consecutive_pairs(df, "e", "t", ["x"]).count() == 1
    flat = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (3.0, 4.0)], "a double, b double")
    aad = {r["variable"]: r["aad"] for r in panel.scale_table(flat, ["a", "b"]).collect()}
    assert aad["a"] == 1.0 and math.isclose(aad["b"], 1.0)
    assert panel.near_constant(flat, ["a", "b", "b"]) == ["b"]
    kept, dropped = panel.complete_rows(spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double"), ["a", "b"])
    assert (kept.count(), dropped.count()) == (1, 1)


# -- linkage -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(7)
    parts = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], [400, 3]), "c": 10.0 ** rng.uniform(-200, 200, 300), "d": np.array([5.0]), "e": np.concatenate([[-1e300, 1e300], rng.normal(size=99)])}
    rows = [(k, float(v)) for k, x in parts.items() for v in x] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    probs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, ["k"], "x", probs, most).collect()}
    assert set(got) == set(parts) and all(np.allclose(got[k], np.quantile(x, probs), rtol=1e-12) for k, x in parts.items())
    whole_ = quantiles.exact_quantiles(df.where("k in ('a', 'b')"), [], "x", [0.5], most).collect()
    assert np.allclose(whole_[0]["q"], np.quantile(np.concatenate([parts["a"], parts["b"]]), [0.5]))
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "x", [0.5], most).count() == 0


def test_nearest_date_edges(spark):
    day = datetime.date(2001, 6, 1)
    shift = lambda n: day + datetime.timedelta(n)
    rows = [(1, 0, shift(120)), (2, 0, shift(121)), (3, 1, shift(5)), (3, 0, shift(-5)), (4, 0, None)]
    events, targets = spark.createDataFrame(rows, "k int, o int, d date"), spark.createDataFrame([(i, day) for i in range(1, 5)], "k int, t date")
    got = linkage.nearest_date(events, targets, "k", "d", "t", 120, [F.col("o")])
    assert sorted(values(got, "k", "o", "gap")) == [(1, 0, 120), (3, 0, 5)]


def test_matching_and_identities(spark):
    left = spark.createDataFrame([("s", 1, "ann lee", 1990), ("s", 2, "bob ray", None), ("s", 3, "cy dee", 1990)], "b string, id int, name string, year int")
    right = spark.createDataFrame([("s", 10, "lee ann", 1990), ("s", 11, "ann lee", 1991), ("s", 12, "bob rai", 1970), ("s", 13, "cy dee", 1993)], "b string, cand int, cname string, cyear int")
    got = linkage.match_blocked(left, right, ["b"], "id", "cand", "name", "cname", "year", "cyear")
    assert values(got, "id", "cand") == [(1, 10)]
    rows = [("t", "a", 1, "ann lee", 1990, 95.0, 1.0), ("t", "b", 2, "lee ann", 1991, 99.0, 1.0), ("u", "c", 1, "x y", 1990, 90.0, 5.0), ("u", "d", 1, "x y", 1990, 90.0, 9.0)]
    df = spark.createDataFrame(rows, "i string, k string, p int, n string, y int, s double, w double")
    out = {r["k"]: (r["same_person"], r["keeps_ident"]) for r in linkage.resolve_identities(df, "i", "k", "p", "n", "y", "s", "w").collect()}
    assert out == {"a": (True, True), "b": (True, True), "c": (False, False), "d": (False, True)}


# -- clustering --------------------------------------------------------------------------------------------------------------------


def toy(n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.1, (n // 3, 2)) for c in (0, 3, 6)])
    return distance.l1_matrix(x) / 12


def whole(*matrices):
    return fcm.Distances(len(matrices[0]), [d**2 for d in matrices])


def test_fits():
    d = toy()
    assert np.allclose(distance.jaccard_matrix(np.array([[0, 0], [1, 0], [1, 1]])), [[0, 1, 1], [1, 0, 0.5], [1, 0.5, 0]])
    fit = fcm.fit_best(whole(d), fcm.FitConfig(k=3, starts=6, weights=(1.0,)))
    assert np.allclose(fit.u.sum(1), 1) and fit.converged and len(set(fit.medoids)) == 3
    truth = np.repeat([0, 1, 2], 20)
    assert fcm.adjusted_rand(fit.labels, truth) > 0.9 and fcm.adjusted_rand(truth, truth) == 1
    runs = [fcm.fit_starts(whole(d), fcm.FitConfig(k=3, weights=(1.0,)), [s])[0] for s in range(6)]
    together = fcm.fit_starts(whole(d), fcm.FitConfig(k=3, weights=(1.0,)), list(range(6)))
    assert fit.objective == pytest.approx(min(r.objective for r in runs))
    assert all(a.medoids == b.medoids and a.rounds == b.rounds and np.allclose(a.u, b.u) and a.objective == pytest.approx(b.objective) for a, b in zip(runs, together))
    noise = [(fcm.fit_best(whole(d), fcm.FitConfig(k=3, rho=rho, starts=6, weights=(1.0,))).u[:, 3]).sum() for rho in (0.2, 1.0)]
    assert noise[0] >= noise[1]
    same = np.zeros((6, 6))
    assert fcm.fit_starts(whole(same), fcm.FitConfig(k=2, weights=(1.0,)), [0])[0].xie_beni == float("inf")
    free = fcm.fit_best(whole(d, d), fcm.FitConfig(k=3, starts=2, weight_floor=0.2))
    assert math.isclose(free.weights.sum(), 1) and free.weights.min() >= 0.2


def brute_fit(squares, config, seed):
    """One fit, written step by step from the definition."""
    k, m, n = config.k, config.m, len(squares[0])
    w = np.full(len(squares), 1 / len(squares)) if config.weights is None else np.array(config.weights) / sum(config.weights)
    medoids = fcm.seed_medoids(fcm.Distances(n, squares), w, k, np.random.default_rng(seed))
    d2 = lambda i, j: sum(x * x * s[i, j] for x, s in zip(w, squares))
    delta = config.rho * np.mean([d2(i, c) for i in range(n) for c in medoids])

    def law(i):
        v = [max(x, 1e-12) ** (-1 / (m - 1)) for x in [*(d2(i, c) for c in medoids), delta]]
        return [x / sum(v) for x in v]

    for _ in range(config.most_rounds):
        um = [[x**m for x in law(i)[:k]] for i in range(n)]
        if config.weights is None:
            inverse = np.array([1 / (sum(um[i][c] * s[i, medoids[c]] for i in range(n) for c in range(k)) + 1e-12) for s in squares])
            w = inverse / inverse.sum()
        delta = config.rho * np.mean([d2(i, c) for i in range(n) for c in medoids])
        new = []
        for c in range(k):
            new.append(min((h for h in range(n) if h not in new), key=lambda h: sum(um[i][c] * d2(h, i) for i in range(n))))
        if new == medoids:
            break
        medoids = new
    return medoids, np.array([law(i) for i in range(n)])


def test_fits_against_brute_force():
    rng = np.random.default_rng(3)
    for weights in ((0.6, 0.4), None):
        config = fcm.FitConfig(k=3, m=1.4, rho=1.0, weights=weights)
        squares = [distance.l1_matrix(rng.normal(size=(25, 2))) ** 2 / 9 for _ in range(2)]
        for seed in range(4):
            medoids, u = brute_fit(squares, config, seed)
            fit = fcm.fit_starts(fcm.Distances(25, squares), config, [seed])[0]
            assert fit.medoids == medoids and np.allclose(fit.u, u)


def test_large_cells_are_fitted_in_blocks():
    rng = np.random.default_rng(4)
    types = distance.Types(("a", "b"), ("c",), ("p", "q"))
    x = {c: rng.normal(size=400) for c in "abc"} | {c: rng.integers(0, 2, 400).astype(float) for c in "pq"}
    for weights in ((0.4, 0.3, 0.3), None):
        config = fcm.FitConfig(k=3, starts=3, weights=weights)
        kept, blocks = (fcm.fit_best(fcm.Distances.of(x, types, (2.0, 1.0, 1.0), most), config) for most in (1000, 10))
        assert kept.medoids == blocks.medoids and np.allclose(kept.u, blocks.u) and math.isclose(kept.objective, blocks.objective)
    import tracemalloc

    big = {c: rng.normal(size=20_000) for c in "abc"} | {c: rng.integers(0, 2, 20_000).astype(float) for c in "pq"}
    tracemalloc.start()
    fit = fcm.fit_best(fcm.Distances.of(big, types, (2.0, 1.0, 1.0)), fcm.FitConfig(k=2, starts=1, weights=(0.4, 0.3, 0.3), most_rounds=1))
    assert len(fit.u) == 20_000 and tracemalloc.get_traced_memory()[1] < 500 << 20  # one matrix would take 3200 MB
    tracemalloc.stop()


def test_assignment():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n in (1, 3, 6):
        cost = rng.random((n, n))
        best = min(permutations(range(n)), key=lambda p: sum(cost[i, p[i]] for i in range(n)))
        assert math.isclose(sum(cost[i, j] for i, j in enumerate(align.hungarian(cost))), sum(cost[i, best[i]] for i in range(n)))


def test_assignment_ties(spark):
    costs = spark.createDataFrame([(0, a, b, 1.0) for a in (1, 2, 3) for b in (1, 2, 3)], "g int, a int, b int, cost double")
    assert sorted(values(align.optimal_assignment(costs, ["g"], 3), "a", "b")) == [(1, 1), (2, 2), (3, 3)]


# -- econometrics ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(0)
    g = np.repeat(np.arange(60), 5)
    x = rng.normal(size=(300, 2)) + rng.normal(size=60)[g][:, None]
    y = 1 + x @ [0.5, -1] + rng.normal(size=60)[g] + rng.normal(size=300)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, (c, d) in zip(g, y, x)], "g int, y double, a double, b double")
    return g, x, y, df


def test_ols_against_numpy(regression):
    g, x, y, df = regression
    fit = econometrics.ols_clustered(df, "y", ["a", "b"], "g")
    X = np.column_stack([np.ones(300), x])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    bread = np.linalg.inv(X.T @ X)
    scores = np.stack([(X[g == k] * e[g == k, None]).sum(0) for k in range(60)])
    cov = bread @ scores.T @ scores @ bread * 60 / 59 * 299 / 297
    assert np.allclose(fit.coef, beta) and np.allclose(fit.cov, cov) and 0 <= fit.wald(["a", "b"]) < 1e-6
    r2 = 1 - e @ e / ((y - y.mean()) ** 2).sum()
    assert math.isclose(fit.adj_r2, 1 - (1 - r2) * 299 / 297)
    twin = econometrics.ols_clustered(df.withColumn("c", F.col("a")), "y", ["a", "b", "c"], "g")
    assert np.allclose(twin.coef[1] + twin.coef[3], beta[1])


def test_many_regressions_at_once(spark, regression):
    """The models of all keys, from two passes, are those of one regression after the other."""
    g, x, y, df = regression
    rng = np.random.default_rng(1)
    more = df.withColumn("still", F.lit(3.0)).withColumn("d", F.col("a") * F.col("b")).repartition(5)
    both = more.withColumn("key", F.lit("p")).unionByName(more.where("g % 3 > 0").withColumn("key", F.lit("q")))
    specs = lambda k, total, names: {"m": (["a", "still"], ["b", "d"]), "n": (["a"], ["b"])}
    got = {(r.key, r.model): r for r in econometrics.nested_models(both, "key", ["a", "b", "d", "still"], "y", "g", specs, reps=4)}
    assert len(got) == 4 and rng is not None
    for k, part in (("p", more), ("q", more.where("g % 3 > 0"))):
        for m, base, added in (("m", ["a"], ["b", "d"]), ("n", ["a"], ["b"])):
            one, r = econometrics.compare(part, "y", base, added, "g"), got[k, m]
            assert (r.n, r.added) == (one["n"], added) and r.entities == (60 if k == "p" else 40)
            assert r.adj_r2_base == pytest.approx(one["adjR2_base"]) and r.adj_r2_ext == pytest.approx(one["adjR2_ext"]) and r.wald_p == pytest.approx(one["wald_p"], rel=1e-6)
            fit = econometrics.ols_clustered(part, "y", [*base, *added], "g")
            at = [fit.names.index(c) for c in added]
            assert np.allclose(r.coef, fit.coef[at]) and np.allclose(r.se, fit.se[at])
            cv = econometrics.grouped_cv(part, "y", {"base": base, "ext": [*base, *added]}, "g", reps=4)
            assert r.oos_base == pytest.approx(np.mean(cv["base"])) and r.oos_ext == pytest.approx(np.mean(cv["ext"]))
    assert econometrics.nested_models(both.limit(0), "key", ["a"], "y", "g", specs) == []


def test_cv_and_panel_models(regression):
    g, x, y, df = regression
    got = econometrics.grouped_cv(df, "y", {"mean": [], "full": ["a", "b"]}, "g", reps=3)
    assert len(got["full"]) == 3 and all(f > m for f, m in zip(got["full"], got["mean"])) and all(m < 0.05 for m in got["mean"])
    names, fe = econometrics.fixed_effects(df.withColumn("still", F.col("g").cast("double")), "y", ["a", "b", "still"], "g")
    within = lambda v: v - np.stack([v[g == k].mean(0) for k in range(60)])[g]
    b = np.linalg.lstsq(within(x), within(y), rcond=None)[0]
    assert names == ["a", "b"] and np.allclose(fe.coef, b)
    re, theta = econometrics.random_effects(df, "y", ["a", "b"], "g")
    assert 0 < theta < 1 and re.coef[re.names.index("b")] == pytest.approx(-1, abs=0.3)
    stat, k, p = econometrics.hausman(fe, re)
    assert stat >= 0 and k >= 1 and 0 <= p <= 1
    vec, share, need = econometrics.pca(df, ["a", "b", "y"])
    assert math.isclose(share.sum(), 1) and np.allclose(vec.T @ vec, np.eye(3)) and 1 <= need <= 3


def test_resampling(spark):
    df = spark.range(3000).select(F.col("id").alias("e"), F.lit(1).alias("x"))
    got = resample.resample_entities(df, "e", range(2))
    n = {r["replicate"]: r["count"] for r in got.groupBy("replicate").count().collect()}
    assert n == {0: 3000, 1: 3000} and got.groupBy("replicate", "draw_id").count().where("count > 1").isEmpty()
    assert got.where("copy > 0").count() > 0 and len(resample.grid({"a": [1, 2], "b": [3]})) == 2
    assert resample.fingerprint({"a": 1}) != resample.fingerprint({"a": 2})
    draws = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 3.5)], "a double, b double")
    assert 0 <= resample.wald_from_draws(draws, {"a": 2.0, "b": 2.0}) <= 1


# -- text and files ----------------------------------------------------------------------------------------------------------------


def test_text_audit(spark):
    a = spark.createDataFrame([(1, "See 12 items \\cite{x} % note 5\nand $a  b$. This sentence stays the same here. A long sentence that will be gone soon."), (2, "x")], "id int, text string")
    b = spark.createDataFrame([(1, "See 13 items \\cite{x}\nand $a b$. This sentence stays the same here. Another new sentence with quite other words."), (2, "x")], "id int, text string")
    items = {(r["category"], r["item"]) for r in textdiff.extract_items(a, "id", "text").collect()}
    assert ("numbers", "12") in items and ("numbers", "5") not in items and ("math", "$a b$") in items and ("references", "\\cite{x}") in items
    changes = textdiff.multiset_changes(textdiff.extract_items(a, "id", "text"), textdiff.extract_items(b, "id", "text"), ["id", "category", "item"])
    assert {r["id"]: r["verdict"] for r in textdiff.verdicts(changes, a, "id").collect()} == {1: "CHECK", 2: "OK"}
    split = lambda df: df.select("id", F.explode(textdiff.sentences(F.col("text"))).alias("s"))
    kinds = [r["kind"] for r in textdiff.changed_sentences(split(a), split(b), "id", "s").collect()]
    assert "changed" in kinds and len(kinds) >= 2


def python_sentences(t):
    """The rule of the audit in plain Python."""
    t = re.sub(r"(?<!\\)%.*", "", t)
    t = re.sub(r"\\begin\{(table\*?|figure\*?|equation\*?|align\*?)\}.*?\\end\{\1\}", " ", t, flags=re.S)
    parts = re.split(r"(?<=[.!?])\s+(?=[A-Z\\$])", re.sub(r"\s+", " ", t))
    return [p.strip() for p in parts if len(p.strip()) > 25]


HARD_TEXTS = [
    "A sentence of some length ends here. and this goes on in lower case! Now a new one begins, it is long. $x$ is a formula that starts one. \\cite{a} starts another one here.",
    "Exactly twenty-five chars. Twenty-six characters long", "no end", "", "  A text \u00a0 with\u2003odd\x1cspaces.\u3000Next sentence of the odd text is here.\n\nÜber is not A to Z, so no split before it here.",
    "Before it.\n\\begin{table}\nA row in a table that is long enough. Another row that is long.\n\\end{table}\nAfter the table there is a sentence.", "50\\% stays here as it is. % but this comment goes away. It does.\nThe next line is kept whole here.",
    "\\begin{table}a\\begin{figure}b\\end{table} Text that comes after the first end.\\end{figure}", "\\begin{align*}x\\end{align} y \\end{align*} What is left is this sentence here.", None,
]


def test_sentences_follow_the_rule(spark):
    df = spark.createDataFrame(list(enumerate(HARD_TEXTS)), "id int, text string")
    got = {r["id"]: r["s"] for r in df.select("id", textdiff.sentences(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(HARD_TEXTS):
        assert got[i] == (None if t is None else python_sentences(t)), repr(t)


def test_items_of_all_categories(spark):
    text = (
        "\\chapter{One  two} See \\ref{a}, \\cite[p.~3]{b c} and 1,200.5\\% of .25; -- and --- but ---- not. ``Said'' \"so\" $a\n b$ \\footnote{A note.}\n"
        "\\begin{table*}x \\begin{equation}1+1\\end{equation} y\\end{table*} \\[ z \\] \\begin{quote}q\\end{quote} % \\cite{gone}"
    )
    got = Counter((r["category"], r["item"]) for r in textdiff.extract_items(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").collect())
    assert got == Counter({
        ("blocks", "\\begin{table*}x \\begin{equation}1+1\\end{equation} y\\end{table*}"): 1, ("blocks", "\\begin{equation}1+1\\end{equation}"): 1, ("blocks", "\\begin{quote}q\\end{quote}"): 1, ("blocks", "\\[ z \\]"): 1,
        ("numbers", "1,200.5"): 1, ("numbers", ".25"): 1, ("numbers", "1"): 2, ("references", "\\ref{a}"): 1, ("references", "\\cite[p.~3]{b c}"): 1, ("math", "$a b$"): 1,
        ("environments", "table*"): 1, ("environments", "equation"): 1, ("environments", "quote"): 1, ("headings", "\\chapter{One two}"): 1, ("footnotes", "\\footnote{A note.}"): 1,
        ("dashes", "--"): 1, ("dashes", "---"): 1, ("quotes", "``"): 1, ("quotes", "''"): 1, ("quotes", '"'): 2,
    })


def test_claims(spark):
    rows = [(1, "It may be weak, and weakly so.", "It may be weak, and weakly so!", "changed"), (1, "It may be weak here.", "It is weak here.", "changed"), (1, "It took 5 days.", "It took 6 days.", "changed"), (1, "gone", None, "deleted"), (1, None, "new", "added")]
    df = spark.createDataFrame(rows, "id int, before string, after string, kind string")
    assert sorted(r["before"] or "" for r in textdiff.claim_changes(df).collect()) == ["", "It may be weak here.", "It took 5 days.", "gone"]
    docs = spark.createDataFrame([(1, "This is not a weak claim; it is WEAK, no doubt about it."), (2, "short")], "id int, text string")
    got = {(r["id"], r["term"]): r["n"] for r in textdiff.term_counts(docs, "id", "text").collect()}
    assert got == {(1, "weak"): 2, (1, "not "): 1, (1, "no "): 1, (1, "about"): 1}


def test_diagnostics_of_configs_of_several_k(spark):
    rng = np.random.default_rng(3)
    rows = []
    for config, k in (("two", 2), ("three", 3)):
        for i in range(60):
            u = rng.dirichlet([0.3] * (k + 1)).tolist()
            rows.append((config, i % 3, u, int(np.argmax(u)) + 1, 0.5 + i % 3, float("nan"), False))
    df = spark.createDataFrame(rows, "config string, cell int, u array<double>, hard int, xie_beni double, stability double, degenerate boolean")
    for r in fcm.fit_diagnostics(df, ["cell"]).collect():
        own, k = [x for x in rows if x[0] == r["config"]], {"two": 2, "three": 3}[r["config"]]
        assert math.isclose(r["noise_share"], sum(x[3] == k + 1 for x in own) / 60)
        assert math.isclose(r["crisp"], sum(max(x[2][:k]) >= 0.7 for x in own) / 60)
        sizes = [sum(x[1] == c and x[3] == h for x in own) for c in range(3) for h in range(1, k + 1)]
        assert r["min_size"] == min(n for n in sizes if n)


def brute_matches(old, new, least=0.45):
    free, out = sorted(new), []
    for s in sorted(old):
        near = difflib.get_close_matches(s, free, n=1, cutoff=least)
        if near:
            free.remove(near[0])
        out.append((s, near[0] if near else None, "changed" if near else "deleted"))
    return out + [(None, s, "added") for s in free if not any(difflib.SequenceMatcher(None, s, a).ratio() > least for a in old)]


def test_matches_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    words = ["the", "a", "river", "Müller", "漢字", "17", "stone", "walks", "z" * 40]
    text = lambda n: " ".join(rng.choice(words, n))
    for longest in (4, 12, 60):  # short ones tie, long ones have characters that difflib takes as too common
        old = {text(rng.integers(1, longest)) for _ in range(40)}
        new = {s.replace("the", "a") for s in list(old)[:25]} - old | {text(rng.integers(1, longest)) for _ in range(10)} | {"qqqqqqqqqqqqqqqqqqqqqqqq"}
        assert textdiff.match_sentences(list(old), list(new)) == brute_matches(old, new)
    assert textdiff.match_sentences([], []) == []


def test_versions_in_one_row(spark):
    one, two, three, four = (f"This is sentence number {x} of the test." for x in ("one", "two", "three", "4"))
    rows = [(1, [one, two], [two, three]), (2, [one], [two]), (2, [two], [one, four]), (None, [one], [one]), (3, [one], [one]), (4, None, [one]), (5, [], []), (6, [one], None)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    side = lambda c: df.select("id", F.explode(c).alias("s"))
    plain = lambda d: sorted(map(repr, d.collect()))
    got = plain(textdiff.changed_within(df, "id", "a", "b"))
    assert got == plain(textdiff.changed_sentences(side("a"), side("b"), "id", "s")) and len(got) >= 5


def test_changed_sentences_read_every_document(spark, sf):
    from cohortlab.plans import catalog

    got = catalog.QUERIES["tx5_changed_sentences"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", textdiff.sentences(F.col("text")).alias("a"), textdiff.sentences(F.replace(F.replace("text", F.lit("1"), F.lit("7")), F.lit(" the "), F.lit(" a "))).alias("b")).where("text is not null").collect()
    lost = {(r["doc_id"], s) for r in docs for s in set(r["a"]) - set(r["b"])}
    assert lost and {(r["doc_id"], r["before"]) for r in got if r["before"] is not None} == lost


def test_files(spark, sf):
    assert io.optional_table(spark, f"{sf}/absent.parquet", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        io.first_existing(spark, [f"{sf}/absent"])
    bad = spark.createDataFrame([('{"k": 1}',), ("{broken",), (None,)], "t string")
    assert [r[0] for r in io.histories(bad, "t", "struct<k: int>").select("history.k").collect()] == [1, None, None]
    assert "\\midrule" in io.latex_table(spark.createDataFrame([(1.5, "a_b")], "x double, s string"))
