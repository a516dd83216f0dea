"""Registered queries: design matrices, regressions, cross-validation, panel estimators, bootstrap and grids."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_tail, holm, normal_two_sided
from ..operators import align as A
from ..operators import econometrics as E
from ..operators import fcm
from ..operators import panel as P
from ..operators import resample as R
from ..operators import settings as S
from ..sources.io import staged
from .base import SCALED, TYPES, K, Registry, cells, panel, r, rounded, scaled_sample, with_base
from .clustering import MAIN, RATES, T_ALL, _transitions, both_rates, constants_by, constants_of, fit_configs

registry = Registry()
add = registry.add
Spark = SparkSession
FIRST, LAST, MOST_K = 1995, 2001, 6
SEASONS = [f"s_{t}" for t in range(FIRST + 1, LAST)]
_LD = lambda names: [f"{x}_{n}" for n in names for x in ("L", "D")]
#: Columns of the core controls, of the other statistics that the clustering uses, and of two further blocks. Periods since an entity was first seen stand in for its age.
CORE = ["tenure", "tenure_sq", "log_minutes", "d_log_minutes", "pos_F", "pos_O", "ppm", "dppm", "club_change", *_LD(["npg", "tackles"]), *SEASONS]
OTHERS = {"raw": _LD(["sot", "sot_rate", "g_sh"]), "shrunk": _LD(["sot", "sot_rate_shr", "g_sh_shr"])}
EXTRA = OTHERS["raw"]
BLOCKS = {"core": CORE, "full": [*CORE, *EXTRA], "minimal": [c for c in CORE if c not in _LD(["npg", "tackles"])], "position": ["pos_O", "D_pos_F", "D_pos_O", "D_pos_P"]}
_STATS = {"npg": "s_npg_p90", "sot": "s_sot_p90", "tackles": "s_tackles_p90", "sot_rate": "s_sot_rate", "g_sh": "s_g_sh"}

DESIGN = f"""seen AS (SELECT uid, MIN(season) AS since FROM scaled GROUP BY uid),
design AS (SELECT a.uid, a.season, ln(b.value) - ln(a.value) AS y, CAST(a.season - since AS DOUBLE) AS tenure, pow(CAST(a.season - since AS DOUBLE), 2) AS tenure_sq, a.log_minutes, b.log_minutes - a.log_minutes AS d_log_minutes,
  a.minutes AS minutes_t, b.minutes AS minutes_t1, a.pos_F, a.pos_O, a.pos_P, a.ppm, b.ppm - a.ppm AS dppm, CAST(a.club_main <> b.club_main AS INTEGER) AS club_change, CAST(a.n_clubs AS DOUBLE) AS n_clubs,
  {', '.join(f'a.{c} AS L_{n}, b.{c} - a.{c} AS D_{n}' for n, c in _STATS.items())}, b.pos_F - a.pos_F AS D_pos_F, b.pos_O - a.pos_O AS D_pos_O, b.pos_P - a.pos_P AS D_pos_P,
  {', '.join(f'CAST(a.season = {s[2:]} AS INTEGER) AS {s}' for s in SEASONS)}
  FROM scaled a JOIN scaled b ON a.uid = b.uid AND b.season = a.season + 1 JOIN seen ON seen.uid = a.uid WHERE a.ppm IS NOT NULL AND b.ppm IS NOT NULL)"""


def design_of(x: DataFrame, stats: dict[str, str]) -> DataFrame:
    """One row for each consecutive pair with outcome, levels and changes; rows that lack a control are dropped."""
    names = ["value", "ppm", "minutes", "log_minutes", "pos_F", "pos_O", "pos_P", "n_clubs", "club_main", "since", *stats.values()]
    p = P.consecutive_pairs(x.withColumn("since", F.min("season").over(Window.partitionBy("uid"))), "uid", "season", names)
    change = lambda c: F.col(f"{c}_t1") - F.col(f"{c}_t")
    tenure = (F.col("season") - F.col("since_t")).cast("double")
    out = p.where("ppm_t is not null and ppm_t1 is not null").select(
        "uid", "season", (F.log("value_t1") - F.log("value_t")).alias("y"), tenure.alias("tenure"), F.pow(tenure, 2.0).alias("tenure_sq"), F.col("log_minutes_t").alias("log_minutes"), change("log_minutes").alias("d_log_minutes"),
        "minutes_t", "minutes_t1", *[F.col(f"{c}_t").alias(c) for c in ("pos_F", "pos_O", "pos_P", "ppm")], change("ppm").alias("dppm"), (F.col("club_main_t") != F.col("club_main_t1")).cast("int").alias("club_change"), F.col("n_clubs_t").cast("double").alias("n_clubs"),
        *[e for n, c in stats.items() for e in (F.col(f"{c}_t").alias(f"L_{n}"), change(c).alias(f"D_{n}"))], *[change(c).alias(f"D_{c}") for c in ("pos_F", "pos_O", "pos_P")],
    )
    return staged(P.one_hot(out, "season", list(range(FIRST, LAST)), "s"), "design")


def design(spark: Spark, sf: str) -> DataFrame:
    """The design with raw rates, staged: regressions read it in several passes."""
    return design_of(staged(scaled_sample(spark, sf), "scaled"), _STATS)


def du_names(k: int, reference: int) -> list[str]:
    return [f"du_{j}" for j in range(1, k + 1) if j != reference] + ["du_noise"]


def with_changes(spark: Spark, sf: str, scaled: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The design with membership changes du_1.., du_noise, levels u_1.., u_noise and their summaries; and the names of the changes but that of the reference cluster, which has the largest mean membership."""
    scaled = staged(scaled_sample(spark, sf), "scaled") if scaled is None else scaled  # read by the clustering and by the design
    t = staged(_transitions(spark, sf, cells(spark, sf, scaled)), "transitions")
    columns = [F.element_at(v, j).alias(f"{n}_{j}") for n, v in (("du", "delta"), ("u", "u_t")) for j in range(1, K + 1)]
    du = t.select("uid", "season", *columns, F.element_at("delta", K + 1).alias("du_noise"), F.element_at("u_t", K + 1).alias("u_noise"), "u_t1", "transition_norm", "delta_entropy")
    data = staged(design_of(scaled, _STATS).join(du, ["uid", "season"]), "design")
    reference = int(E.reference_cluster(data, [f"u_{j}" for j in range(1, K + 1)])[2:])
    return data, du_names(K, reference)


@add("ec1_design_matrix", with_base(DESIGN) + f"SELECT uid, season, {', '.join(f'{r(c)} AS {c}' for c in ['y', *CORE, *EXTRA])} FROM design")
def _(spark: Spark, sf: str) -> DataFrame:
    return design(spark, sf).select("uid", "season", *[rounded(c).alias(c) for c in ["y", *CORE, *EXTRA]])


@add("ec2_reference_cluster", with_base(*T_ALL) + "SELECT CASE WHEN a >= b AND a >= c THEN 'u1' WHEN b >= c THEN 'u2' ELSE 'u3' END AS reference FROM (SELECT AVG(a1) AS a, AVG(a2) AS b, AVG(a3) AS c FROM tr)")
def _(spark: Spark, sf: str) -> DataFrame:
    u = _transitions(spark, sf).select(*[F.element_at("u_t", k).alias(f"u{k}") for k in range(1, K + 1)])
    return spark.createDataFrame([(E.reference_cluster(u, [f"u{k}" for k in range(1, K + 1)]),)], "reference string")


@add("ec3_ols", with_base(DESIGN) + f"SELECT {r('regr_slope(y, d_log_minutes)')} AS slope, {r('regr_intercept(y, d_log_minutes)')} AS intercept, COUNT(*) AS n FROM design")
def _(spark: Spark, sf: str) -> DataFrame:
    fit = E.ols_clustered(design(spark, sf), "y", ["d_log_minutes"], "uid")
    return spark.createDataFrame([(float(fit.coef[1]), float(fit.coef[0]), fit.n)], "slope double, intercept double, n long").select(rounded("slope").alias("slope"), rounded("intercept").alias("intercept"), "n")


@add("ec4_clustered_errors", with_base(DESIGN, "c AS (SELECT uid, y - my AS y, x - mx AS x FROM (SELECT uid, y, d_log_minutes AS x FROM design), (SELECT AVG(y) AS my, AVG(d_log_minutes) AS mx FROM design))", "b AS (SELECT SUM(x * y) / SUM(x * x) AS b, SUM(x * x) AS sxx, COUNT(*) AS n, COUNT(DISTINCT uid) AS g FROM c)", "s AS (SELECT SUM(sc * sc) AS meat FROM (SELECT SUM(x * (y - b * x)) AS sc FROM c, b GROUP BY uid))") + f"SELECT {r('b')} AS coef, {r('sqrt(meat / (sxx * sxx) * g / (g - 1) * (n - 1) / (n - 2))')} AS se, CAST(g AS BIGINT) AS clusters FROM b, s")
def _(spark: Spark, sf: str) -> DataFrame:
    fit = E.ols_clustered(design(spark, sf), "y", ["d_log_minutes"], "uid")
    return spark.createDataFrame([(float(fit.coef[1]), float(fit.se[1]), fit.groups)], "coef double, se double, clusters long").select(rounded("coef").alias("coef"), rounded("se").alias("se"), "clusters")


@add("ec5_wald_block")
def _(spark: Spark, sf: str) -> DataFrame:
    data, du = with_changes(spark, sf)
    fit = E.ols_clustered(data, "y", [*CORE, *du], "uid")
    return spark.createDataFrame([("du", fit.wald(du), fit.wald(du, f_form=False))], "block string, p_f double, p_chi2 double")


_ONE = ["c AS (SELECT uid, y - my AS y, x - mx AS x FROM (SELECT uid, y, d_log_minutes AS x FROM design), (SELECT AVG(y) AS my, AVG(d_log_minutes) AS mx FROM design))", "b AS (SELECT SUM(x * y) / SUM(x * x) AS b, SUM(x * x) AS sxx, SUM(y * y) AS syy, COUNT(*) AS n, COUNT(DISTINCT uid) AS g FROM c)", "s AS (SELECT SUM(sc * sc) AS meat FROM (SELECT SUM(x * (y - b * x)) AS sc FROM c, b GROUP BY uid))"]


@add("ec5_wald_statistic", with_base(DESIGN, *_ONE) + f"SELECT {r('b * b / (meat / (sxx * sxx) * g / (g - 1) * (n - 1) / (n - 2))', 3)} AS statistic, CAST(1 AS BIGINT) AS df, CAST(g - 1 AS BIGINT) AS df_denominator FROM b, s")
def _(spark: Spark, sf: str) -> DataFrame:
    """The F statistic of a block of one column, from the same covariance as the block test."""
    fit = E.ols_clustered(design(spark, sf), "y", ["d_log_minutes"], "uid")
    stat, df, den = fit.wald_statistic(["d_log_minutes"])
    return spark.createDataFrame([(stat, df, den)], "x double, df long, df_denominator long").select(rounded("x", 3).alias("statistic"), "df", "df_denominator")


@add("ec6_adjusted_r2", with_base(DESIGN) + f"SELECT {r('1 - (1 - regr_r2(y, d_log_minutes)) * (COUNT(*) - 1) / (COUNT(*) - 2)')} AS adj_r2 FROM design")
def _(spark: Spark, sf: str) -> DataFrame:
    fit = E.ols_clustered(design(spark, sf), "y", ["d_log_minutes"], "uid")
    return spark.createDataFrame([(float(fit.adj_r2),)], "x double").select(rounded("x").alias("adj_r2"))


@add("ec7_nested_models")
def _(spark: Spark, sf: str) -> DataFrame:
    """Two baselines, five additions, five settings of the clustering, each with 30 repetitions of grouped cross-validation."""
    settings = {f"{rates}_k{k}": (rates, replace(MAIN, k=k)) for rates, k in (("shrunk", 4), ("raw", 4), ("shrunk", 3), ("shrunk", 5), ("raw", 3))}
    found, _ = evaluate(spark, sf, settings, added=("du", "norm", "dH", "levels", "levels+du"), reps=30)
    rows = [(x.key, *x.model.split(" + ", 1), x.n, len(x.added), x.adj_r2_base, x.adj_r2_ext, x.adj_r2_ext - x.adj_r2_base, x.wald_p, x.oos_base, x.oos_ext, x.oos_ext - x.oos_base, x.share_better) for x in found]
    return spark.createDataFrame(rows, "config string, base string, added string, n long, k_added long, adjR2_base double, adjR2_ext double, d_adjR2 double, wald_p double, oos_R2_base double, oos_R2_ext double, d_oos double, share_cv_better double")


@add("ec7_one_added", with_base(DESIGN, "m AS (SELECT COUNT(*) AS n, regr_r2(y, log_minutes) AS r1, corr(y, log_minutes) AS a, corr(y, d_log_minutes) AS b, corr(log_minutes, d_log_minutes) AS c FROM design)") + f"SELECT n, {r('1 - (1 - r1) * (n - 1) / (n - 2)')} AS adjR2_base, {r('1 - (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)) * (n - 1) / (n - 3)')} AS adjR2_ext FROM m")
def _(spark: Spark, sf: str) -> DataFrame:
    x = E.compare(design(spark, sf), "y", ["log_minutes"], ["d_log_minutes"], "uid")
    return spark.createDataFrame([(x["n"], x["adjR2_base"], x["adjR2_ext"])], "n long, a double, b double").select("n", rounded("a").alias("adjR2_base"), rounded("b").alias("adjR2_ext"))


@add("ec8_grouped_cv")
def _(spark: Spark, sf: str) -> DataFrame:
    data, du = with_changes(spark, sf)
    got = E.grouped_cv(data, "y", {"base": CORE, "extended": [*CORE, *du]}, "uid", reps=30)
    return spark.createDataFrame([(i, a, b, b - a) for i, (a, b) in enumerate(zip(got["base"], got["extended"]))], "rep int, oos_base double, oos_ext double, gain double")


def _fold_sql(rep: int, folds: int = 5) -> str:
    """One repetition's out-of-sample R2 of a regression on one column and a constant, with the fold of an entity taken from its number."""
    sums = "COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy, SUM(y * y) AS syy"
    train = ", ".join(f"t.{c} - f.{c} AS {c}" for c in ("n", "sx", "sy", "sxx", "sxy"))
    return f"""SELECT {rep} AS rep, 1 - SUM(e.syy - 2 * a * e.sy - 2 * b * e.sxy + a * a * e.n + 2 * a * b * e.sx + b * b * e.sxx) / SUM(e.syy - 2 * my * e.sy + my * my * e.n) AS r2
      FROM (SELECT fold, (sy - b * sx) / n AS a, b, sy / n AS my FROM (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b FROM (SELECT f.fold, {train} FROM
        (SELECT (uid * 7 + {rep}) % {folds} AS fold, {sums} FROM d GROUP BY 1) f, (SELECT {sums} FROM d) t))) m
      JOIN (SELECT (uid * 7 + {rep}) % {folds} AS fold, {sums} FROM d GROUP BY 1) e USING (fold)"""


@add("ec8_one_column", with_base(DESIGN, "d AS (SELECT uid, y, d_log_minutes AS x FROM design)") + f"SELECT CAST(rep AS INTEGER) AS rep, {r('r2')} AS r2 FROM (" + " UNION ALL ".join(_fold_sql(rep) for rep in range(3)) + ")")
def _(spark: Spark, sf: str) -> DataFrame:
    """Grouped cross-validation of one regressor, with folds that SQL can form too."""
    fold = lambda e, rep, folds: F.pmod(e * 7 + rep, F.lit(folds)).cast("int")
    got = E.grouped_cv(design(spark, sf), "y", {"one": ["d_log_minutes"]}, "uid", reps=3, fold=fold)
    return spark.createDataFrame(list(enumerate(got["one"])), "rep int, x double").select("rep", rounded("x").alias("r2"))


@add("ec9_coefficient_table")
def _(spark: Spark, sf: str) -> DataFrame:
    """Both baselines with membership changes, at three m."""
    settings = {f"m{m}": ("shrunk", replace(MAIN, m=m)) for m in (1.3, 1.4, 1.5)}
    found, _ = evaluate(spark, sf, settings, reps=0)
    rows = [(x.key, x.model.split(" + ")[0], n, float(b), float(s), normal_two_sided(b / s) if s > 0 else None) for x in found for n, b, s in zip(x.added, x.coef, x.se)]
    return spark.createDataFrame(rows, "config string, base string, term string, coef double, se double, p double").withColumn("pct", 100 * F.expm1(0.1 * F.col("coef")))


@add("ec9_one_coefficient", with_base(DESIGN, *_ONE) + f"SELECT 'd_log_minutes' AS term, {r('b')} AS coef, {r('sqrt(meat / (sxx * sxx) * g / (g - 1) * (n - 1) / (n - 2))')} AS se, {r('100 * (exp(0.1 * b) - 1)', 4)} AS pct FROM b, s")
def _(spark: Spark, sf: str) -> DataFrame:
    fit = E.ols_clustered(design(spark, sf), "y", ["d_log_minutes"], "uid")
    rows = spark.createDataFrame([(fit.names[1], float(fit.coef[1]), float(fit.se[1]))], "term string, coef double, se double")
    return rows.select("term", rounded("coef").alias("coef"), rounded("se").alias("se"), rounded(100 * F.expm1(0.1 * F.col("coef")), 4).alias("pct"))


@add("ec10_minimal_baseline")
def _(spark: Spark, sf: str) -> DataFrame:
    """Membership changes beside the core controls without those of performance, and beside the core, at three m."""
    settings = {f"m{m}": ("shrunk", replace(MAIN, m=m)) for m in (1.3, 1.4, 1.5)}
    found, _ = evaluate(spark, sf, settings, baselines=("minimal", "core"), reps=10)
    return spark.createDataFrame([(x.key, x.model.split(" + ")[0], x.n, len(x.added), x.adj_r2_base, x.adj_r2_ext, x.adj_r2_ext - x.adj_r2_base, x.wald_p, x.oos_ext - x.oos_base) for x in found], "config string, base string, n long, k_added long, adjR2_base double, adjR2_ext double, d_adjR2 double, wald_p double, d_oos double")


@add("ec11_fixed_effects", with_base(DESIGN, "d AS (SELECT uid, y - AVG(y) OVER w AS y, d_log_minutes - AVG(d_log_minutes) OVER w AS x FROM design WINDOW w AS (PARTITION BY uid))") + f"SELECT {r('b')} AS coef, {r('sqrt((syy - b * sxy) / (n - g - 1) / sxx)')} AS se FROM (SELECT SUM(x * y) / SUM(x * x) AS b, SUM(x * x) AS sxx, SUM(x * y) AS sxy, SUM(y * y) AS syy, COUNT(*) AS n, COUNT(DISTINCT uid) AS g FROM d)")
def _(spark: Spark, sf: str) -> DataFrame:
    _, fit = E.fixed_effects(design(spark, sf), "y", ["d_log_minutes"], "uid")
    return spark.createDataFrame([(float(fit.coef[0]), float(fit.se[0]))], "coef double, se double").select(rounded("coef").alias("coef"), rounded("se").alias("se"))


def _panel_columns(du: list[str]) -> list[str]:
    """What entity effects can identify: periods since an entity was first seen rise by one a period, so they are left out."""
    return [c for c in [*CORE, *du] if not c.startswith("tenure")]


@add("ec12_random_effects")
def _(spark: Spark, sf: str) -> DataFrame:
    data, du = with_changes(spark, sf)
    fit, theta = E.random_effects(data, "y", _panel_columns(du), "uid")
    return spark.createDataFrame([(n, float(b), float(s), theta) for n, b, s in zip(fit.names, fit.coef, fit.se)], "term string, coef double, se double, theta double")


@add("ec13_hausman")
def _(spark: Spark, sf: str) -> DataFrame:
    data, du = with_changes(spark, sf)
    names, fe = E.fixed_effects(data, "y", _panel_columns(du), "uid")
    re, _ = E.random_effects(data, "y", names, "uid")
    return spark.createDataFrame([(*E.hausman(fe, re), "unadjusted covariances")], "stat double, df long, p double, warning string")


@add("ec14_panel_block_tests")
def _(spark: Spark, sf: str) -> DataFrame:
    data, du = with_changes(spark, sf)
    names, fe = E.fixed_effects(data, "y", _panel_columns(du), "uid", clustered=True)
    re, _ = E.random_effects(data, "y", names, "uid")
    block = [c for c in du if c in names]
    return spark.createDataFrame([("fixed", fe.wald(block, f_form=False)), ("random", re.wald(block, f_form=False))], "model string, p double")


@add("ec15_pca")
def _(spark: Spark, sf: str) -> DataFrame:
    cols = [*TYPES.performance, *TYPES.rates]
    vectors, share, need = E.pca(staged(scaled_sample(spark, sf), "scaled"), cols)
    return spark.createDataFrame([(i + 1, float(share[i]), need, *map(float, vectors[:, i])) for i in range(len(cols))], "component int, share double, components_for_70 int, " + ", ".join(f"{c} double" for c in cols))


@add("ec15_two_columns", with_base() + f"SELECT {r('(1 + abs(c)) / 2')} AS first_share, {r('(1 - abs(c)) / 2')} AS second_share FROM (SELECT corr(s_npg_p90, s_tackles_p90) AS c FROM scaled)")
def _(spark: Spark, sf: str) -> DataFrame:
    """Shares of variance of two columns' components, which their correlation fixes."""
    _, share, _ = E.pca(staged(scaled_sample(spark, sf), "scaled"), ["s_npg_p90", "s_tackles_p90"])
    return spark.createDataFrame([(float(share[0]), float(share[1]))], "a double, b double").select(rounded("a").alias("first_share"), rounded("b").alias("second_share"))


@add("ec15_pca_benchmark")
def _(spark: Spark, sf: str) -> DataFrame:
    """Do changes of principal-component scores explain the outcome as membership changes do?"""
    cols = [*TYPES.performance, *TYPES.rates]
    scaled = staged(scaled_sample(spark, sf), "scaled")
    z = staged(A.z_scores(scaled.select("uid", "season", *cols), cols), "z-scores")
    vectors, _, need = E.pca(z, cols)
    scores = z.select("uid", "season", *[sum([F.lit(float(v)) * F.col(f"z_{c}") for v, c in zip(vectors[:, j], cols)], F.lit(0.0)).alias(f"pc{j}") for j in range(len(cols))])
    names = [f"pc{j}" for j in range(len(cols))]
    d = P.consecutive_pairs(scores, "uid", "season", names).select("uid", "season", *[(F.col(f"{n}_t1") - F.col(f"{n}_t")).alias(f"d{n}") for n in names])
    data, du = with_changes(spark, sf, scaled)
    data = staged(data.join(d, ["uid", "season"]), "design")
    blocks = {"memberships": du, "as many components": [f"dpc{j}" for j in range(min(len(du), len(cols)))], "components for 70%": [f"dpc{j}" for j in range(need)], "all components": [f"dpc{j}" for j in range(len(cols))]}
    out = [(label, E.compare(data, "y", BLOCKS["core"], [c for c in block], "uid")) for label, block in blocks.items()]
    return spark.createDataFrame([(label, x["n"], x["wald_p"], x["d_adjR2"]) for label, x in out], "summary string, n long, wald_p double, d_adjR2 double")


# -- grids of clusterings and the bootstrap --------------------------------------------------------------------------------------------


def _z(base: DataFrame, rates: str) -> tuple[DataFrame, list[str]]:
    columns = RATES[rates].columns
    return staged(A.z_scores(base, columns).select("nation", "season", "uid", *[f"z_{c}" for c in columns]), "z-scores"), [f"z_{c}" for c in columns]


def aligned_configs(base: DataFrame, found: DataFrame) -> DataFrame:
    """(config, rates, k, nation, season, uid, u, hard, label_of): memberships of all fits in the order of the labels, aligned over periods by nation; label_of: the label of a medoid, else null.

    All settings of one kind of rates and one K go through each step together.
    """
    cell, out = ["nation", "season"], []
    for rates, k in sorted(tuple(x) for x in found.select("rates", "k").distinct().collect()):  # as many as kinds of rates and K
        own, (zed, z) = found.where((F.col("rates") == rates) & (F.col("k") == k)), _z(base, rates)
        prof = staged(A.profiles(zed.join(own.select("config", *cell, "uid", "u"), [*cell, "uid"]), ["config", *cell], "u", k, z), "profiles")
        steps = A.optimal_assignment(A.profile_costs(prof, ["config", "nation"], "season", z), ["config", *cell], k)
        labels = staged(A.propagate_labels(staged(steps, "assignment"), ["config", "nation"], "season", FIRST, LAST, k), "labels")
        moved = A.relabel(own.select("config", "rates", "k", *cell, "uid", "medoid_of", "u"), labels, ["config", *cell], "u", k)
        medoid = labels.withColumnsRenamed({"cluster": "medoid_of", "label": "label_of"})
        out.append(moved.join(F.broadcast(medoid), ["config", *cell, "medoid_of"], "left"))  # k labels a cell and setting
    return staged(reduce(DataFrame.unionByName, out), "aligned") if out else found.withColumn("label_of", F.lit(None).cast("int"))


def changes(aligned: DataFrame, key: list[str]) -> DataFrame:
    """(key, season, du_1.. du_noise, u_1.. u_noise, norm, dH, noise of both periods) of consecutive pairs; clusters beyond a setting's K are 0."""
    t = A.transitions(aligned, key, "season", "u")
    at = lambda v, j: F.when(F.size(v) > j, F.element_at(v, j)).otherwise(F.lit(0.0))
    columns = [at(F.col(v), j).alias(f"{n}_{j}") for n, v in (("du", "delta"), ("u", "u_t")) for j in range(1, MOST_K + 1)]
    last = [F.element_at(v, -1).alias(n) for n, v in (("du_noise", "delta"), ("u_noise", "u_t"), ("u_noise_t1", "u_t1"))]
    same = F.when((F.col("hard_t") < F.size("u_t")) & (F.col("hard_t1") < F.size("u_t")), (F.col("hard_t") == F.col("hard_t1")).cast("double"))
    return t.select(*key, "season", *columns, *last, F.col("transition_norm").alias("norm"), F.col("delta_entropy").alias("dH"), same.alias("same"))


_MOVES = [f"{n}_{j}" for n in ("du", "u") for j in [*range(1, MOST_K + 1), "noise"]] + ["norm", "dH"]
_SHRUNK_STATS = _STATS | {"sot_rate_shr": "s_sot_rate_shr", "g_sh_shr": "s_g_sh_shr"}
_ALL_STATS = list(dict.fromkeys([*CORE, *OTHERS["raw"], *OTHERS["shrunk"]]))


def blocks_of(total: np.ndarray | None, names: list[str], k: int, rates: str, reference: int | None = None) -> dict[str, list[str]]:
    """Columns of each block for a setting; the reference cluster has the largest mean membership, the first on ties."""
    if reference is None:
        means = [total[0, names.index(f"u_{j}")] for j in range(1, k + 1)]
        reference = int(np.argmax(means)) + 1
    du = du_names(k, reference)
    levels = [c[1:] for c in du]
    return {"du": du, "norm": ["norm"], "dH": ["dH"], "levels": levels, "levels+du": [*levels, *du], "core": CORE, "full": [*CORE, *OTHERS[rates]], "minimal": BLOCKS["minimal"]}


def evaluate(spark: Spark, sf: str, settings: dict[str, tuple[str, fcm.FitConfig]], added: tuple[str, ...] = ("du",), baselines: tuple[str, ...] = ("core", "full"), reps: int = 10) -> tuple[list[E.Nested], list[dict]]:
    """(what each block adds to each baseline, facts of the clustering) of each setting (rates, fit).

    All settings go through every step together. Fits are kept as medoids, so rows and settings are never multiplied in what is written.
    """
    base, cell = both_rates(spark, sf), ["nation", "season"]
    keyed = base.where("nation is not null and season is not null")  # rows without a cell count for the scales only
    kinds, scales, parts = list(dict.fromkeys(x for x, _ in settings.values())), {}, []
    every = constants_by(base, kinds)
    for rates in kinds:
        constants = every[rates, "sd"]
        scales[rates] = tuple(c if c else 1.0 for c in constants)
        parts.append(S.fit_summaries(keyed, cell, "uid", RATES[rates], {n: c for n, (x, c) in settings.items() if x == rates}, constants))
    columns = list(dict.fromkeys(c for x in kinds for c in RATES[x].columns))
    row = base.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    found = staged(reduce(DataFrame.unionByName, parts), "fits")
    types = {x: RATES[x] for x in kinds}
    groups, places, facts = S.aligned_groups(found, settings, types, scales, {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}, FIRST, LAST)
    pairs = setting_pairs(keyed, columns)

    def specs(name: str, g: S.Group, reference: int) -> dict[str, tuple[list[str], list[str]]]:
        b = blocks_of(None, [], g.k, g.rates, reference)
        return {f"{base_} + {a}": (b[base_], b[a]) for base_ in baselines for a in added}

    results, persistence = S.nested_over_settings(pairs, groups, places, types, _ALL_STATS, "y", "uid", specs, added != ("du",), reps)
    return results, [f | {"persistence": persistence.get(n)} for n, f in facts.items()]


def setting_pairs(base: DataFrame, columns: list[str]) -> DataFrame:
    """All consecutive pairs, staged: (uid, nation, season, the statistics of `design_of`, y, __ok, and the columns that are clustered at both periods); __ok: has the pair all statistics?"""
    w = Window.partitionBy("uid")
    names = list(dict.fromkeys(["value", "ppm", "log_minutes", "pos_F", "pos_O", "pos_P", "club_main", *columns, *_SHRUNK_STATS.values()]))
    both = base.select("uid", "nation", "season", *names).withColumn("since", F.min("season").over(w)).withColumn("then", F.lead(F.struct("season", *names)).over(w.orderBy("season"))).where(F.col("then.season") == F.col("season") + 1)
    now, then = F.col, lambda c: F.col(f"then.{c}")
    tenure = (F.col("season") - F.col("since")).cast("double")
    stats = {"y": F.log(then("value")) - F.log("value"), "tenure": tenure, "tenure_sq": F.pow(tenure, 2.0), "d_log_minutes": then("log_minutes") - now("log_minutes"), "dppm": then("ppm") - now("ppm"), "club_change": (now("club_main") != then("club_main")).cast("int")}
    stats |= {f"L_{n}": now(c) for n, c in _SHRUNK_STATS.items()} | {f"D_{n}": then(c) - now(c) for n, c in _SHRUNK_STATS.items()} | {x: (F.col("season") == int(x[2:])).cast("int") for x in SEASONS}
    sides = [f(c).cast("double").alias(f"{c}_{at}") for c in columns for at, f in (("t", now), ("t1", then))]
    out = both.select("uid", "nation", "season", *[stats.get(c, F.col(c)).cast("double").alias(c) for c in [*_ALL_STATS, "y"]], *sides)
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in [*_ALL_STATS, "y"]])
    return staged(out.withColumn("__ok", ok), "pairs")


_GRID = "config string, rates string, k int, rho double, m double, seed int, pairs long, xie_beni double, noise_share double, crisp double, persistence double, core_p double, core_dR2 double, core_dOOS double, full_p double, full_dR2 double, full_dOOS double"


def grid_rows(spark: Spark, sf: str, settings: dict[str, tuple[str, fcm.FitConfig]], reps: int = 10) -> DataFrame:
    """One row a setting: facts of the clustering, and what membership changes add to both baselines."""
    return rows_of(spark, settings, *evaluate(spark, sf, settings, reps=reps))


def rows_of(spark: Spark, settings: dict[str, tuple[str, fcm.FitConfig]], results: list[E.Nested], facts: list[dict]) -> DataFrame:
    by, fact, rows = {(x.key, x.model.split(" + ")[0]): x for x in results}, {f["config"]: f for f in facts}, []
    for name, (rates, c) in settings.items():
        f, own = fact.get(name, {}), [by.get((name, b)) for b in ("core", "full")]
        tested = [v for x in own for v in ((None, None, None) if x is None else (x.wald_p, x.adj_r2_ext - x.adj_r2_base, x.oos_ext - x.oos_base))]
        rows.append((name, rates, c.k, c.rho, c.m, c.seed, own[0].n if own[0] else 0, *(f.get(n) for n in ("xie_beni", "noise_share", "crisp", "persistence")), *[None if v is None or v != v else float(v) for v in tested]))
    return spark.createDataFrame(rows, _GRID)


def specification_grid() -> dict[str, tuple[str, fcm.FitConfig]]:
    """All 2 x 4 x 3 x 5 settings, named by the fingerprint of their values."""
    axes = R.grid({"rates": ["shrunk", "raw"], "k": [3, 4, 5, 6], "rho": [0.75, 1.0, 1.5], "m": [1.2, 1.3, 1.4, 1.5, 2.0]})
    return {x["fingerprint"]: (x["rates"], replace(MAIN, k=x["k"], rho=x["rho"], m=x["m"])) for x in axes}


@add("ec18_specification_grid")
def _(spark: Spark, sf: str) -> DataFrame:
    return grid_rows(spark, sf, specification_grid())


@add("ec19_seed_study")
def _(spark: Spark, sf: str) -> DataFrame:
    """30 seeds at each of five m; a fit's starts take the seeds from 100 times its number on."""
    return grid_rows(spark, sf, {f"m{m}_seed{s}": ("shrunk", replace(MAIN, m=m, seed=100 * s)) for m in (1.2, 1.3, 1.4, 1.5, 2.0) for s in range(30)})


@add("ec20_sensitivity")
def _(spark: Spark, sf: str) -> DataFrame:
    return grid_rows(spark, sf, {f"rho{rho}_m{m}": ("shrunk", replace(MAIN, rho=rho, m=m)) for rho, m in ((1.0, 1.3), (0.75, 1.3), (1.5, 1.3), (1.0, 1.2), (1.0, 1.5))}, reps=1)


@add("ec22_restricted_grid")
def _(spark: Spark, sf: str) -> DataFrame:
    """The grid by m, over all settings and over those whose labels are consistent in every pair of periods of every nation: shares of p below 0.05 and median gains."""
    settings = {n: x for n, x in specification_grid().items() if x[1].rho == MAIN.rho}
    results, facts = evaluate(spark, sf, settings, reps=1)
    ok = spark.createDataFrame([(f["config"], None if f["aligned_ok"] is None else int(f["aligned_ok"])) for f in facts], "config string, aligned_ok int")
    grid = staged(rows_of(spark, settings, results, facts).join(ok, "config", "left"), "grid")
    out = lambda rows, name: rows.groupBy("m").agg(F.lit(name).alias("runs"), F.count(F.lit(1)).alias("n"), *[F.avg((F.col(f"{b}_p") < 0.05).cast("double")).alias(f"{b}_sig") for b in ("core", "full")], *[F.median(f"{b}_dR2").alias(f"{b}_dR2") for b in ("core", "full")])  # noqa: E731 (a row a setting)
    return out(grid, "all").unionByName(out(grid.where("aligned_ok = 1"), "consistent"))


@add("ec16_resampled_entities")
def _(spark: Spark, sf: str) -> DataFrame:
    drawn = R.resample_entities(panel(spark, sf).select("uid", "season", "minutes"), "uid", range(3))
    return drawn.groupBy("replicate").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("draw_id").alias("draws"), F.countDistinct("uid").alias("entities"))


REPLICATES = 500


def bootstrap_draws(spark: Spark, sf: str, replicates: int | None = None) -> tuple[DataFrame, list[E.Nested]]:
    """(draws, estimates of the sample): both stages anew in each replicate: entities are drawn, periods clustered and anchored to the original profiles, both models fitted.

    replicates: REPLICATES, if None. draws: (replicate, baseline, one column a membership change, gain in adjusted R2). The cell of a fit is (replicate, nation, season), so replicates run side by side.
    """
    base, cell, key = both_rates(spark, sf), ["nation", "season"], ["replicate", "nation", "season"]
    k, rates = MAIN.k, "shrunk"
    constants, (zed, z) = constants_of(base, rates), _z(base, rates)
    found = fit_configs(base, {"main": (rates, MAIN)})
    aligned = aligned_configs(base, found)
    fixed = staged(A.profiles(zed.join(aligned.select(*cell, "uid", "u"), [*cell, "uid"]), cell, "u", k, z), "original")
    data = design_of(base, _SHRUNK_STATS)
    moves = staged(changes(aligned, ["config", "uid"]).join(data, ["uid", "season"]), "pairs")
    spec = lambda _, total, names: {b: (blocks_of(total, names, k, rates)[b], blocks_of(total, names, k, rates)["du"]) for b in ("core", "full")}
    estimates = E.nested_models(moves, "config", [*_ALL_STATS, *_MOVES], "y", "uid", spec, reps=0)
    reference = int(E.reference_cluster(moves, [f"u_{j}" for j in range(1, k + 1)])[2:]) if estimates else 1
    drawn = R.resample_entities(base.select("uid", *cell, *RATES[rates].columns), "uid", range(REPLICATES if replicates is None else replicates))
    fitted = fcm.fit_cells(drawn, key, "draw_id", RATES[rates], {"main": MAIN}, constants)
    fitted = staged(fitted.select(*key, "draw_id", F.substring_index("draw_id", "#", 1).cast("long").alias("uid"), "u"), "fits")
    prof = A.profiles(fitted.join(zed, [*cell, "uid"]), key, "u", k, z)
    labels = A.anchor_by(prof, fixed, key, cell, z, k).select(*key, F.col("a").alias("cluster"), F.col("b").alias("label"))
    member = A.relabel(fitted, staged(labels, "labels"), key, "u", k)
    columns = [*_ALL_STATS, *_MOVES]
    pairs = changes(member.select("replicate", "draw_id", "uid", "season", "u", "hard"), ["replicate", "draw_id", "uid"]).join(data, ["uid", "season"])
    centred, _ = E.centred(staged(pairs.select("replicate", "uid", *columns, "y"), "pairs"), [*columns, "y"])
    names, out = ["const", *columns], []
    du = du_names(k, reference)
    for row in E.fold_grams(centred, "replicate", [*columns, "y"], "uid", 1, 1).toLocalIterator():  # one row a replicate
        g = np.array(row["g"]).reshape(len(names) + 1, -1)
        for b in ("core", "full"):
            kept = E.varying(g, [names.index(c) for c in blocks_of(g, names, k, rates, reference)[b]])
            both = [0, *kept, *[names.index(c) for c in du]]
            large, small = E.from_gram(g, both), E.from_gram(g, [0, *kept])
            out.append((int(row["key"]), b, *map(float, large["beta"][-len(du) :]), float(large["adj_r2"] - small["adj_r2"])))
    schema = "replicate int, baseline string, " + ", ".join(f"{c} double" for c in [f"du_{j}" for j in range(1, k + 1) if j != reference] + ["du_noise"]) + ", gain double"
    return spark.createDataFrame(sorted(out), schema), estimates


@add("ec16_two_stage_bootstrap")
def _(spark: Spark, sf: str) -> DataFrame:
    draws, _ = bootstrap_draws(spark, sf)
    moved = [c for c in draws.columns if c.startswith("du_")]
    return draws.select("replicate", "baseline", F.posexplode(F.array(*moved)).alias("__at", "coef"), "gain").select("replicate", "baseline", F.element_at(F.array(*[F.lit(c) for c in moved]), F.col("__at") + 1).alias("term"), "coef", "gain")


@add("ec17_bootstrap_summary")
def _(spark: Spark, sf: str) -> DataFrame:
    """Standard errors, normal intervals and bias of the draws' membership changes beside the sample's, and the chi-squared Wald test of the whole block, for both baselines."""
    draws, estimates = bootstrap_draws(spark, sf)
    draws, parts = staged(draws, "draws"), []
    for x in estimates:
        own = draws.where(F.col("baseline") == x.model)
        table = R.summarize_draws(own, {c: (float(b), float(s)) for c, b, s in zip(x.added, x.coef, x.se)})
        wald = R.wald_from_draws(own, dict(zip(x.added, map(float, x.coef))))
        parts.append(table.withColumn("baseline", F.lit(x.model)).withColumn("wald_p", F.lit(wald)).withColumn("replicates", F.lit(own.count())))
    return reduce(DataFrame.unionByName, parts)


_DRAWS = "draws AS (SELECT season, AVG(y) AS a, AVG(d_log_minutes) AS b FROM design GROUP BY season)"


@add("ec17_summary_formulas", with_base(DESIGN, _DRAWS) + " UNION ALL ".join(f"SELECT '{t}' AS term, {r(f'stddev_samp({t})')} AS boot_se, {r(f'stddev_samp({t}) / {s}')} AS se_ratio, {r(f'{c} - 1.96 * stddev_samp({t})')} AS ci_low, {r(f'{c} + 1.96 * stddev_samp({t})')} AS ci_high, {r(f'AVG({t}) - {c}')} AS boot_bias FROM draws" for t, c, s in (("a", 0.05, 0.02), ("b", -0.1, 0.04))))
def _(spark: Spark, sf: str) -> DataFrame:
    """The summary's formulas on a table of draws that SQL can form: the mean outcome and exposure change of each period."""
    draws = design(spark, sf).groupBy("season").agg(F.avg("y").alias("a"), F.avg("d_log_minutes").alias("b"))
    out = R.summarize_draws(draws, {"a": (0.05, 0.02), "b": (-0.1, 0.04)})
    return out.select("term", *[rounded(c).alias(c) for c in ("boot_se", "se_ratio", "ci_low", "ci_high", "boot_bias")])


_SAMPLES = ["all", "winsorised", "stayers", "non_zero", "exposed", "without_1997_1998", "young", "little_noise"]


@add("ec21_variations")
def _(spark: Spark, sf: str) -> DataFrame:
    """Eight samples or outcomes, both baselines; a sample of fewer than 200 pairs is left out."""
    data, du = with_changes(spark, sf)
    clipped = P.clip_between(data, "y", 0.01, 0.99, "y_clipped")
    parts = [
        data, clipped.withColumn("y", F.col("y_clipped")), data.where("club_change = 0"), data.where("y <> 0"), data.where("minutes_t >= 60 and minutes_t1 >= 60"),
        data.where("season not in (1997, 1998)"), data.where("tenure <= 3"), data.where(f"u_noise <= 0.5 and element_at(u_t1, {K + 1}) <= 0.5"),
    ]
    columns = list(dict.fromkeys([*BLOCKS["full"], *du]))
    every = reduce(DataFrame.unionByName, [part.select("uid", *columns, "y").withColumn("variation", F.lit(name)) for name, part in zip(_SAMPLES, parts)])
    found = E.nested_models(staged(every, "variations"), "variation", columns, "y", "uid", lambda key, total, names: {b: (BLOCKS[b], du) for b in ("core", "full")}, reps=0)
    by = {(x.key, x.model): x for x in found if x.n >= 200}
    out = [(n, by[n, "core"].n, by[n, "core"].entities, *[v for b in ("core", "full") for v in (by[n, b].wald_p, by[n, b].adj_r2_ext - by[n, b].adj_r2_base)]) for n in _SAMPLES if (n, "core") in by]
    return spark.createDataFrame(out, "variation string, n long, entities long, core_p double, core_dR2 double, full_p double, full_dR2 double")


@add("ec21_sample_sizes", with_base(DESIGN) + " UNION ALL ".join(f"SELECT '{n}' AS variation, COUNT(*) AS n, COUNT(DISTINCT uid) AS entities, {r(f'AVG({y})')} AS mean_y FROM design{f' WHERE {w}' if w else ''}" for n, w, y in (("all", "", "y"), ("winsorised", "", "least(greatest(y, (SELECT quantile_cont(y, 0.01) FROM design)), (SELECT quantile_cont(y, 0.99) FROM design))"), ("stayers", "club_change = 0", "y"), ("non_zero", "y <> 0", "y"), ("exposed", "minutes_t >= 60 AND minutes_t1 >= 60", "y"), ("without_1997_1998", "season NOT IN (1997, 1998)", "y"), ("young", "tenure <= 3", "y"))))
def _(spark: Spark, sf: str) -> DataFrame:
    """Rows, entities and mean outcome of the variations that need no clustering."""
    d = design(spark, sf)
    where = {"all": "true", "winsorised": "true", "stayers": "club_change = 0", "non_zero": "y <> 0", "exposed": "minutes_t >= 60 and minutes_t1 >= 60", "without_1997_1998": "season not in (1997, 1998)", "young": "tenure <= 3"}
    clipped = P.clip_between(d, "y", 0.01, 0.99, "y_clipped")
    parts = [(clipped if n == "winsorised" else d).where(w).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("entities"), rounded(F.avg("y_clipped" if n == "winsorised" else "y")).alias("mean_y")).withColumn("variation", F.lit(n)) for n, w in where.items()]
    return reduce(DataFrame.unionByName, parts)


@add("ec23_position_changes", with_base(DESIGN) + "SELECT uid, season, pos_O, D_pos_F, D_pos_O, D_pos_P FROM design")
def _(spark: Spark, sf: str) -> DataFrame:
    return design(spark, sf).select("uid", "season", *BLOCKS["position"])


@add("ec24_holm", with_base() + "SELECT nation, " + r("least(1, MAX((n - rk + 1) * p) OVER (ORDER BY rk))", 9) + " AS adjusted FROM (SELECT *, COUNT(*) OVER () AS n, row_number() OVER (ORDER BY p, nation) AS rk FROM (SELECT nation, ROUND(exp(-STDDEV_SAMP(s_npg_p90) * nation / 5), 12) AS p FROM cells GROUP BY nation))")
def _(spark: Spark, sf: str) -> DataFrame:
    """Step-down adjustment of one p-value a nation, a figure of the panel that lies between 0 and 1."""
    spread = both_rates(spark, sf).groupBy("nation").agg(F.round(F.exp(-F.stddev_samp("s_npg_p90") * F.col("nation") / 5), 12).alias("p"))
    rows = sorted(map(tuple, spread.collect()))  # one row a nation
    return spark.createDataFrame([(n, x) for (n, _), x in zip(rows, holm([p for _, p in rows]))], "nation int, x double").select("nation", rounded("x", 9).alias("adjusted"))


