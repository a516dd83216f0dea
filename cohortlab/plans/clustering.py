"""Registered queries: mixed-type distances, robust fuzzy clustering, alignment over periods and transitions.

Single steps are checked against SQL at the K least entities of each cell as medoids; whole fits are iterative and have no SQL.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import first_max
from ..operators import align as A
from ..operators import distance as D
from ..operators import fcm, pairsums
from ..operators import panel as P
from ..sources.io import staged
from .base import ONCE, SCALED, TYPES, K, Registry, beside_nation, cells, exposed, flagged_panel, r, rounded, with_base

registry = Registry()
add = registry.add
Spark = SparkSession
CELL = ["nation", "season"]
M, RHO = 1.3, 1.0
W = TYPES.weights()
FEATURES = [f"s_{c}" for c in SCALED] + ["pos_F", "pos_O", "pos_P"]
Z = [f"z_{c}" for c in FEATURES]

_D1 = " + ".join(f"ABS(a.{c} - b.{c})" for c in TYPES.performance)
_D2 = " + ".join(f"ABS(a.{c} - b.{c})" for c in TYPES.rates)
_IN = " + ".join(f"a.{c} * b.{c}" for c in TYPES.labels)
_UN = " + ".join(f"a.{c} + b.{c} - a.{c} * b.{c}" for c in TYPES.labels)
_D3 = f"CASE WHEN {_UN} > 0 THEN 1 - ({_IN}) / ({_UN})::DOUBLE ELSE 0 END"
_DIST = f"{_D1} AS d1, {_D2} AS d2, {_D3} AS d3"
PAIRS = f"dist AS (SELECT a.nation, a.season, a.uid AS i, b.uid AS j, {_DIST} FROM cells a JOIN cells b ON a.nation = b.nation AND a.season = b.season AND a.uid < b.uid)"
CONST = "const AS (SELECT MAX(d1) AS c1, MAX(d2) AS c2, 1::DOUBLE AS c3 FROM dist)"
_SQ = lambda a, b, c: f"pow({W[0]!r}::DOUBLE * {a} / c1, 2) + pow({W[1]!r}::DOUBLE * {b} / c2, 2) + pow({W[2]!r}::DOUBLE * {c} / c3, 2)"
NEAR = f"""med AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation, season ORDER BY uid) AS rn FROM cells) WHERE rn <= {K}),
near AS (SELECT nation, season, i, c, d1 / c1 AS d1, d2 / c2 AS d2, d3 / c3 AS d3, {_SQ('d1', 'd2', 'd3')} AS q FROM (SELECT a.nation, a.season, a.uid AS i, b.rn AS c, {_DIST} FROM cells a JOIN med b ON a.nation = b.nation AND a.season = b.season), const),
noise AS (SELECT nation, season, {RHO} * AVG(q) AS delta FROM near GROUP BY nation, season)"""
_LOGIT = lambda x: f"(-ln(greatest({x}, 1e-12::DOUBLE)) / ({M} - 1))"
U = f"""wide AS (SELECT nation, season, i, {', '.join(f'MAX(CASE WHEN c = {k} THEN q END) AS q{k}' for k in range(1, K + 1))} FROM near GROUP BY nation, season, i),
logit AS (SELECT *, {', '.join(f'{_LOGIT(f"q{k}")} AS l{k}' for k in range(1, K + 1))}, {_LOGIT('delta')} AS l{K + 1} FROM wide JOIN noise USING (nation, season)),
top AS (SELECT *, greatest({', '.join(f'l{k}' for k in range(1, K + 2))}) AS lt FROM logit),
u AS (SELECT *, {', '.join(f'exp(l{k} - lt) / tot AS u{k}' for k in range(1, K + 2))} FROM (SELECT *, {' + '.join(f'exp(l{k} - lt)' for k in range(1, K + 2))} AS tot FROM top)),
hard AS (SELECT *, CASE {' '.join(f'WHEN u{k} = greatest({", ".join(f"u{x}" for x in range(1, K + 2))}) THEN {k}' for k in range(1, K + 2))} END AS hard FROM u)"""
_UM = lambda k: f"pow(u{k}, {M})"


def _pairs(spark: Spark, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return D.pair_distances(c, c, CELL, "uid", TYPES)


def _medoids(c: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy("uid"))
    return c.withColumn("c", rank).where(F.col("c") <= K)


def _near(spark: Spark, sf: str, c: DataFrame | None = None) -> DataFrame:
    """(nation, season, i, c, d1, d2, d3, q): scaled distances of every row to its cell's K medoids, and their combined square."""
    c = cells(spark, sf) if c is None else c
    med = _medoids(c)
    const = pairsums.constants_from(pairsums.pair_facts(c, CELL, TYPES))
    d = D.scaled(D.pair_distances(c, med, CELL, "uid", TYPES, ordered=False), const)
    return d.join(med.select(*CELL, F.col("uid").alias("j"), "c"), [*CELL, "j"]).withColumn("q", D.combined_squared(W)).drop("j")


def _memberships(spark: Spark, sf: str, c: DataFrame | None = None) -> DataFrame:
    """(nation, season, i, q1.., delta, u array, hard)."""
    near = staged(_near(spark, sf, c), "near")
    wide = near.groupBy(*CELL, "i").agg(*[F.max(F.when(F.col("c") == k, F.col("q"))).alias(f"q{k}") for k in range(1, K + 1)])
    noise = near.groupBy(*CELL).agg(fcm.noise_distance(RHO, F.col("q")).alias("delta"))
    u = fcm.memberships([F.col(f"q{k}") for k in range(1, K + 1)], F.col("delta"), M)
    return staged(wide.join(noise, CELL).withColumn("u", F.array(*u)).withColumn("hard", first_max(F.col("u"))), "memberships")


def _beside_medoids(c: DataFrame, const) -> DataFrame:  # noqa: ANN001
    """(nation, season, uid, the types' columns, um): the cells with the first medoid's membership to the power m, beside the K medoids in one broadcast row a cell, so no row is written or shuffled."""
    sides = [F.max(F.when(F.col("c") == k, F.col(x))).alias(f"m{k}_{x}") for k in range(1, K + 1) for x in TYPES.columns]
    med = _medoids(c.select(*CELL, "uid", *TYPES.columns)).groupBy(*CELL).agg(*sides)
    both = c.select(*CELL, "uid", *TYPES.columns, *[F.col(x).alias(f"a_{x}") for x in TYPES.columns]).join(F.broadcast(med), CELL)
    for k in range(1, K + 1):
        ds = D.manhattan(TYPES.performance, "a_", f"m{k}_"), D.manhattan(TYPES.rates, "a_", f"m{k}_"), D.jaccard(TYPES.labels, "a_", f"m{k}_")
        both = both.withColumns({f"d{i + 1}": d / F.lit(const[f"c{i + 1}"]) for i, d in enumerate(ds)}).withColumn(f"q{k}", D.combined_squared(W))
    near = both.select(*CELL, "uid", *TYPES.columns, *[f"q{k}" for k in range(1, K + 1)])
    every = F.array(*[f"q{k}" for k in range(1, K + 1)])  # a cell of fewer rows has fewer medoids, and nulls here
    noise = near.select(*CELL, F.explode(every).alias("q")).groupBy(*CELL).agg(fcm.noise_distance(RHO, F.col("q")).alias("delta"))
    u = fcm.memberships([F.col(f"q{k}") for k in range(1, K + 1)], F.col("delta"), M)
    return near.join(F.broadcast(noise), CELL).select(*CELL, "uid", *TYPES.columns, F.pow(u[0], M).alias("um"))


def _u(k: int):  # noqa: ANN202
    return F.element_at("u", k)


# -- distances ---------------------------------------------------------------------------------------------------------------------


@add("cl1_manhattan", with_base(PAIRS) + f"SELECT nation, season, i, j, {r('d1')} AS d1, {r('d2')} AS d2 FROM dist")
def _(spark: Spark, sf: str) -> DataFrame:
    return _pairs(spark, sf).select(*CELL, "i", "j", rounded("d1").alias("d1"), rounded("d2").alias("d2"))


@add("cl2_jaccard", with_base(PAIRS) + f"SELECT nation, season, i, j, {r('d3')} AS d3 FROM dist")
def _(spark: Spark, sf: str) -> DataFrame:
    return _pairs(spark, sf).select(*CELL, "i", "j", rounded("d3").alias("d3"))


@add("cl3_scaling_constants", with_base(PAIRS) + " UNION ALL ".join(f"SELECT '{n}' AS rule, {r(f'{f}(d1)')} AS c1, {r(f'{f}(d2)')} AS c2, {r('1' if n == 'max' else f'{f}(d3)')} AS c3 FROM dist" for n, f in (("max", "MAX"), ("mean", "AVG"), ("sd", "stddev_pop"))))
def _(spark: Spark, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    parts = [D.scaling_constants(pairs, n).select(F.lit(n).alias("rule"), *[rounded(f"c{k}").alias(f"c{k}") for k in (1, 2, 3)]) for n in ("max", "mean", "sd")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@add("cl4_within_period", with_base(PAIRS, CONST) + f"SELECT nation, season, COUNT(*) AS pairs, {r('AVG(d1 / c1)')} AS d1, {r('AVG(d2 / c2)')} AS d2, {r('AVG(d3)')} AS d3 FROM dist, const GROUP BY nation, season")
def _(spark: Spark, sf: str) -> DataFrame:
    """Means over all pairs of each cell, from sorted sums: the pairs are not formed."""
    facts = staged(pairsums.pair_facts(cells(spark, sf), CELL, TYPES), "facts")
    mean = lambda k: F.col(f"s{k}") / F.nullif(f"n{k}", F.lit(0)) / F.nullif(f"c{k}", F.lit(0.0))
    both = facts.where("pairs > 0").crossJoin(F.broadcast(pairsums.constants_from(facts)))
    return both.select(*CELL, "pairs", *[rounded(mean(k)).alias(f"d{k}") for k in (1, 2, 3)])


@add("cl5_cross_period", with_base(PAIRS, CONST, NEAR) + f"SELECT a.nation, a.season, a.rn AS a, b.rn AS b, {r(_D1)} AS d1, {r(_D2)} AS d2, {r(_D3)} AS d3 FROM med a JOIN med b ON a.nation = b.nation AND b.season = a.season + 1")
def _(spark: Spark, sf: str) -> DataFrame:
    med = _medoids(cells(spark, sf)).select(*CELL, "c", *TYPES.columns)
    then = med.withColumn("season", F.col("season") - 1)
    return D.pair_distances(med, then, CELL, "c", TYPES, ordered=False).select(*CELL, F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"), *[rounded(f"d{k}").alias(f"d{k}") for k in (1, 2, 3)])


@add("cl6_type_weights", "SELECT unnest([1, 2, 3]) AS type, unnest([ROUND(sqrt(3) / (sqrt(3) + sqrt(2) + sqrt(3)), 9), ROUND(sqrt(2) / (sqrt(3) + sqrt(2) + sqrt(3)), 9), ROUND(sqrt(3) / (sqrt(3) + sqrt(2) + sqrt(3)), 9)]) AS weight")
def _(spark: Spark, sf: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, round(w, 9)) for i, w in enumerate(W)], "type int, weight double")


@add("cl7_combined_distance", with_base(PAIRS, CONST, NEAR) + f"SELECT nation, season, i, CAST(c AS INTEGER) AS c, {r('q')} AS q FROM near")
def _(spark: Spark, sf: str) -> DataFrame:
    return _near(spark, sf).select(*CELL, "i", "c", rounded("q").alias("q"))


# -- steps of a fit ----------------------------------------------------------------------------------------------------------------


@add("cl8_memberships", with_base(PAIRS, CONST, NEAR, U) + f"SELECT nation, season, i, {', '.join(f'{r(f"u{k}", 5)} AS u{k}' for k in range(1, K + 2))} FROM u")
def _(spark: Spark, sf: str) -> DataFrame:
    return _memberships(spark, sf).select(*CELL, "i", *[rounded(_u(k), 5).alias(f"u{k}") for k in range(1, K + 2)])


@add("cl9_seeding_mass", with_base(PAIRS, CONST, NEAR) + f"SELECT nation, season, i, {r('q / NULLIF(SUM(q) OVER (PARTITION BY nation, season), 0)')} AS p FROM near WHERE c = 1")
def _(spark: Spark, sf: str) -> DataFrame:
    first = _near(spark, sf).where("c = 1")
    return first.select(*CELL, "i", rounded(F.col("q") / F.nullif(F.sum("q").over(Window.partitionBy(*CELL)), F.lit(0.0))).alias("p"))


@add("cl10_noise_distance", with_base(PAIRS, CONST, NEAR, U) + f"SELECT nation, season, {r('MAX(delta)')} AS plain, {r('SUM(' + ' + '.join(f'{_UM(k)} * q{k}' for k in range(1, K + 1)) + f') * {RHO} / (COUNT(*) * {K})')} AS weighted FROM u GROUP BY nation, season")
def _(spark: Spark, sf: str) -> DataFrame:
    weighted = sum([F.pow(_u(k), M) * F.col(f"q{k}") for k in range(2, K + 1)], F.pow(_u(1), M) * F.col("q1"))
    return _memberships(spark, sf).groupBy(*CELL).agg(rounded(F.max("delta")).alias("plain"), rounded(fcm.noise_distance(RHO, weighted, F.lit(1.0), F.count(F.lit(1)) * K)).alias("weighted"))


_LONG_U = f"long_u AS (SELECT nation, season, i, unnest([{', '.join(str(k) for k in range(1, K + 1))}]) AS c, unnest([{', '.join(_UM(k) for k in range(1, K + 1))}]) AS um FROM u)"


def _long_um(members: DataFrame) -> DataFrame:
    return members.select(*CELL, "i", F.posexplode(F.transform(F.slice("u", 1, K), lambda x: F.pow(x, F.lit(M)))).alias("c", "um")).withColumn("c", F.col("c") + 1)


@add("cl11_estimated_weights", with_base(PAIRS, CONST, NEAR, U, _LONG_U) + f"SELECT nation, season, {', '.join(f'{r(f"(1 / a{k}) / (1 / a1 + 1 / a2 + 1 / a3)")} AS w{k}' for k in (1, 2, 3))} FROM (SELECT nation, season, {', '.join(f'SUM(um * d{k} * d{k}) + 1e-12 AS a{k}' for k in (1, 2, 3))} FROM near JOIN long_u USING (nation, season, i, c) GROUP BY nation, season)")
def _(spark: Spark, sf: str) -> DataFrame:
    both = _near(spark, sf).join(_long_um(_memberships(spark, sf)), [*CELL, "i", "c"])
    w = fcm.type_weights(F.col("um"), [F.col(f"d{k}") * F.col(f"d{k}") for k in (1, 2, 3)])
    return both.groupBy(*CELL).agg(*[rounded(x).alias(f"w{k + 1}") for k, x in enumerate(w)])


_FULL = f"full_q AS (SELECT nation, season, i, j, {_SQ('d1', 'd2', 'd3')} AS q FROM dist, const UNION ALL SELECT nation, season, j, i, {_SQ('d1', 'd2', 'd3')} FROM dist, const UNION ALL SELECT nation, season, uid, uid, 0 FROM cells)"


@add("cl12_medoid_update", with_base(PAIRS, CONST, NEAR, U, _FULL) + f"SELECT nation, season, CAST(arg_min(h, (cost, h)) AS BIGINT) AS medoid FROM (SELECT f.nation, f.season, f.i AS h, ROUND(SUM({_UM(1)} * f.q), 9) AS cost FROM full_q f JOIN u ON u.nation = f.nation AND u.season = f.season AND u.i = f.j GROUP BY f.nation, f.season, f.i) GROUP BY nation, season")
def _(spark: Spark, sf: str) -> DataFrame:
    """The first cluster's new medoid; the others have to differ from it, which the fit does in sequence."""
    c = cells(spark, sf, columns=["season", *TYPES.columns])
    row = pairsums.constants_from(pairsums.pair_facts(c, CELL, TYPES)).first()
    return pairsums.least_cost(_beside_medoids(c, row), CELL, "uid", TYPES, "um", W, (row["c1"], row["c2"], row["c3"]))


_OBJ = " + ".join(f"{_UM(k)} * q{k}" for k in range(1, K + 1))


def _inner() -> list:
    return [F.pow(_u(k), M) * F.col(f"q{k}") for k in range(1, K + 1)]


@add("cl14_objective", with_base(PAIRS, CONST, NEAR, U) + f"SELECT nation, season, {r(f'SUM({_OBJ} + {_UM(K + 1)} * delta)')} AS objective FROM u GROUP BY nation, season")
def _(spark: Spark, sf: str) -> DataFrame:
    return _memberships(spark, sf).groupBy(*CELL).agg(rounded(F.sum(sum(_inner()[1:], _inner()[0]) + F.pow(_u(K + 1), M) * F.col("delta"))).alias("objective"))


@add("cl15_xie_beni", with_base(PAIRS, CONST, NEAR, U) + f"SELECT nation, season, CASE WHEN least_q > 0 THEN {r('total / (n * least_q)', 4)} END AS xb FROM (SELECT nation, season, SUM({_OBJ}) AS total, COUNT(*) AS n FROM u GROUP BY 1, 2) JOIN (SELECT n.nation, n.season, MIN(n.q) AS least_q FROM near n JOIN med m ON m.nation = n.nation AND m.season = n.season AND m.uid = n.i AND m.rn <> n.c GROUP BY 1, 2) USING (nation, season)")
def _(spark: Spark, sf: str) -> DataFrame:
    total = _memberships(spark, sf).groupBy(*CELL).agg(F.sum(sum(_inner()[1:], _inner()[0])).alias("total"), F.count(F.lit(1)).alias("n"))
    med = _medoids(cells(spark, sf)).select(*CELL, F.col("uid").alias("i"), F.col("c").alias("own"))
    least = _near(spark, sf).join(med, [*CELL, "i"]).where("c <> own").groupBy(*CELL).agg(F.min("q").alias("least_q"))
    return total.join(least, CELL).select(*CELL, F.when(F.col("least_q") > 0, rounded(F.col("total") / (F.col("n") * F.col("least_q")), 4)).alias("xb"))


@add("cl16_hard_labels", with_base(PAIRS, CONST, NEAR, U) + "SELECT nation, season, hard, COUNT(*) AS n FROM hard GROUP BY ALL")
def _(spark: Spark, sf: str) -> DataFrame:
    return _memberships(spark, sf).groupBy(*CELL, "hard").agg(F.count(F.lit(1)).alias("n"))


@add("cl18_adjusted_rand", with_base() + f"""SELECT {r('(b - x * y / t) / ((x + y) / 2 - x * y / t)')} AS ari FROM (SELECT SUM(n * (n - 1) / 2.0::DOUBLE) AS b, SUM(n) * (SUM(n) - 1) / 2.0::DOUBLE AS t FROM (SELECT COUNT(*) AS n FROM panel GROUP BY club_main, n_clubs)),
  (SELECT SUM(n * (n - 1) / 2.0::DOUBLE) AS x FROM (SELECT COUNT(*) AS n FROM panel GROUP BY club_main)), (SELECT SUM(n * (n - 1) / 2.0::DOUBLE) AS y FROM (SELECT COUNT(*) AS n FROM panel GROUP BY n_clubs))""")
def _(spark: Spark, sf: str) -> DataFrame:
    from .base import panel

    return fcm.adjusted_rand_table(panel(spark, sf), "club_main", "n_clubs").select(rounded("ari").alias("ari"))


@add("cl20_diagnostics", with_base(PAIRS, CONST, NEAR, U) + f"SELECT season, {r(f'AVG((hard = {K + 1})::INTEGER)')} AS noise_share, {r('AVG((greatest(u1, u2, u3) >= 0.7)::INTEGER)')} AS crisp FROM hard GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    crisp = F.array_max(F.slice("u", 1, K)) >= 0.7
    return _memberships(spark, sf).groupBy("season").agg(rounded(F.avg((F.col("hard") == K + 1).cast("double"))).alias("noise_share"), rounded(F.avg(crisp.cast("double"))).alias("crisp"))


# -- whole fits --------------------------------------------------------------------------------------------------------------------

#: Rates as they are, and shrunk to the pooled ones.
RATES = {"raw": TYPES, "shrunk": D.Types(TYPES.performance, ("s_sot_rate_shr", "s_g_sh_shr"), TYPES.labels)}


#: What the clusterings of both rates read; no source (club_main, n_clubs, ppm) is told apart for it.
CLUSTERED = ["uid", "season", "shots", "sot", "npg", *SCALED, *TYPES.labels]


def both_rates(spark: Spark, sf: str, columns: list[str] | None = None) -> DataFrame:
    """The cells with raw and with shrunk rates, scaled, with the labels' flags in place of their set. columns: those of the sample that are needed, all if None.

    The sample is staged beside the nations; pooled rates and scales are put to it wherever it is read.
    """
    own = exposed(flagged_panel(spark, sf, columns is None))
    found = staged(beside_nation(spark, sf, own if columns is None else own.select(*columns)), "sample")
    once, tried = found.where(ONCE), {"sot_rate_shr": "sot", "g_sh_shr": "npg"}
    pooled = once.agg(*[(F.sum(x) / F.sum("shots")).alias(x) for x in tried.values()]).first()
    shrunk = {c: P.shrunk(x, "shots", pooled[x]) for c, x in tried.items()}
    scales = P.pooled_scales(once.withColumns(shrunk), [*SCALED, *tried])
    return P.scaled_by(found.where("__nth is not null").drop("__nth").withColumns(shrunk), scales)


def constants_by(base: DataFrame, kinds: list[str], rules: tuple[str, ...] = ("sd",)) -> dict[tuple[str, str], tuple[float, float, float]]:
    """Scaling constants by (rates, rule), from one pass over the cells."""
    first, *more = kinds
    facts = staged(pairsums.pair_facts(base, CELL, RATES[first], tuple(RATES[x].rates for x in more)), "facts")  # a row a cell
    at = {x: (1, 2 if i == 0 else i + 3, 3) for i, x in enumerate(kinds)}
    return {(x, rule): tuple(pairsums.constants_from(facts, rule, at[x]).first()) for x in kinds for rule in rules}


def constants_of(base: DataFrame, rates: str, rule: str = "sd") -> tuple[float, float, float]:
    return constants_by(base, [rates], (rule,))[rates, rule]


def fit_configs(base: DataFrame, configs: dict[str, tuple[str, fcm.FitConfig]], rule: str = "sd") -> DataFrame:
    """Fits of every (rates, settings) in each cell, with a column `rates`."""
    parts = []
    for rates in dict.fromkeys(r for r, _ in configs.values()):
        own = {n: c for n, (r, c) in configs.items() if r == rates}
        parts.append(fcm.fit_cells(base, CELL, "uid", RATES[rates], own, constants_of(base, rates, rule)).withColumn("rates", F.lit(rates)))
    return staged(reduce(DataFrame.unionByName, parts), "fits")


def fits(spark: Spark, sf: str, configs: dict[str, fcm.FitConfig]) -> DataFrame:
    """Fits of settings with raw rates, for one reader (not staged)."""
    base = cells(spark, sf, columns=["season", *TYPES.columns])
    return fcm.fit_cells(base, CELL, "uid", TYPES, configs, constants_of(base, "raw"))


MAIN = fcm.FitConfig(k=4, m=M, rho=RHO, starts=10, weights=tuple(W))


@add("cl13_fit")
def _(spark: Spark, sf: str) -> DataFrame:
    one = replace(MAIN, k=K, starts=1)
    return fits(spark, sf, {"one start": one}).select(*CELL, "uid", *A.array_columns(F.col("u"), K + 1, "u"), "hard", "medoid_of", "objective")


@add("cl17_best_of_starts")
def _(spark: Spark, sf: str) -> DataFrame:
    return fits(spark, sf, {"best": MAIN}).select(*CELL, "config", "objective", "xie_beni", "stability", "rounds", "converged").distinct()


@add("cl19_parameter_grid")
def _(spark: Spark, sf: str) -> DataFrame:
    """All K and m of the grid, with whether a fit is degenerate in any cell."""
    configs = {f"k{k}_m{m}": replace(MAIN, k=k, m=m) for k in (2, 3, 4, 5, 6) for m in (1.2, 1.3, 1.4, 1.5)}
    base = cells(spark, sf, columns=["season", *TYPES.columns])
    return fcm.facts_diagnostics(fcm.fit_facts(base, CELL, "uid", TYPES, configs, constants_of(base, "raw")))


def _single_period(spark: Spark, sf: str, fit, columns: tuple[str, ...] = (), wanted=lambda name: True) -> DataFrame:  # noqa: ANN001
    """What fit(one period's rows, cell, ident, types, settings, constants) gives, over rates, rho and K; distances are scaled over all periods. wanted: of the settings by name."""
    base, parts = both_rates(spark, sf, [*CLUSTERED, *columns]), []
    every = {x: {f"{x}_rho{rho}_k{k}": replace(MAIN, k=k, rho=rho) for rho in (0.5, 1.0) for k in range(2, 8)} for x in RATES}
    configs = {x: own for x, c in every.items() if (own := {n: s for n, s in c.items() if wanted(n)})}
    constants = constants_by(base, list(configs))
    for rates, own in configs.items():
        parts.append(fit(base.where("season = 1998"), CELL, "uid", RATES[rates], own, constants[rates, "sd"]))
    return reduce(DataFrame.unionByName, parts)


def _most_noise(df: DataFrame, *how) -> DataFrame:  # noqa: ANN002
    """(cell, config, uid, u_noise): the five rows of most noise of each cell and setting, among which are the first five of all cells; NaN is most, as in Spark's order."""

    def of(table, distances, config, fit):  # noqa: ANN001, ANN202
        noise = fit.u[:, -1][distances.own]
        first = np.argsort(-np.where(np.isnan(noise), np.inf, noise), kind="stable")[:5]
        return [table.column("uid").take(pa.array(first)).to_pylist(), noise[first]]

    return fcm.fit_and_reduce(df, *how, f"uid {dict(df.dtypes)['uid']}, u_noise double", of)


PLAIN = ["npg_p90", "sot_p90", "tackles_p90", "sot_rate", "g_sh", "pos_F", "pos_O", "pos_P"]


def _cluster_sums(df: DataFrame, *how) -> DataFrame:  # noqa: ANN002
    """(cell, config, cluster, size, w, PLAIN): hard sizes, and the sums of memberships and of their products with the plain columns, null where a cell has no value."""

    def of(table, distances, config, fit):  # noqa: ANN001, ANN202
        x, m = [table.column(c).to_numpy().astype(float) for c in PLAIN], len(distances.first)
        sums = [fit.u.T @ np.bincount(distances.own, np.nan_to_num(v, nan=0.0), m) for v in x]
        sizes = np.bincount(fit.labels, distances.counts, config.k + 1).astype(int)
        return [np.arange(1, config.k + 2), sizes, fit.u.T @ distances.counts, *[[None] * (config.k + 1) if np.isnan(v).all() else s for v, s in zip(x, sums)]]

    return fcm.fit_and_reduce(df, *how, "cluster int, size long, w double, " + ", ".join(f"{c} double" for c in PLAIN), of, PLAIN)


@add("cl21_single_period")
def _(spark: Spark, sf: str) -> DataFrame:
    """The five rows of most noise of each setting."""
    noise = _single_period(spark, sf, _most_noise)
    top = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("u_noise"), "nation", "uid"))
    return noise.withColumn("place", top).where("place <= 5").select("config", "place", "nation", "uid", rounded("u_noise").alias("u_noise"))


@add("cl21_grid")
def _(spark: Spark, sf: str) -> DataFrame:
    return fcm.facts_diagnostics(_single_period(spark, sf, fcm.fit_facts))


@add("cl21_profiles")
def _(spark: Spark, sf: str) -> DataFrame:
    """Hard sizes and membership-weighted means of each cluster of each setting, noise (K + 1) included, for shrunk rates and K of 3 to 5."""
    sums = _single_period(spark, sf, _cluster_sums, wanted=lambda name: name in [f"shrunk_rho1.0_k{k}" for k in (3, 4, 5)])
    return sums.groupBy("config", "cluster").agg(F.sum("size").alias("size"), *[(F.sum(c) / F.sum("w")).alias(c) for c in PLAIN])


@add("cl22_estimated_weights")
def _(spark: Spark, sf: str) -> DataFrame:
    """Estimated type weights of one period, by scaling rule, rates and K, with whether they degenerate."""
    base, parts = both_rates(spark, sf, CLUSTERED), []
    one, constants = base.where("season = 2000"), constants_by(base, list(RATES), ("max", "mean"))
    for rule in ("max", "mean"):
        for rates, types in RATES.items():
            configs = {f"{rule}_{rates}_k{k}": replace(MAIN, k=k, rho=0.5, weights=None) for k in (3, 4, 5)}
            parts.append(fcm.fit_facts(one, CELL, "uid", types, configs, constants[rates, rule]))
    found = reduce(DataFrame.unionByName, parts)
    noise = (F.element_at("sizes", -1) / F.col("n")).alias("noise_share")
    return found.select(*CELL, "config", *[F.element_at("weights", i + 1).alias(f"w_{n}") for i, n in enumerate(("performance", "rates", "position"))], noise, "xie_beni", "degenerate")


# -- alignment ---------------------------------------------------------------------------------------------------------------------

_ZC = ", ".join(f"({c} - (SELECT AVG({c}) FROM cells)) / NULLIF((SELECT stddev_pop({c}) FROM cells), 0) AS z_{c}" for c in FEATURES)
ZED = f"zed AS (SELECT nation, season, uid, {_ZC} FROM cells)"
PROF = f"prof AS (SELECT nation, season, c AS cluster, {', '.join(f'SUM(w * {z}) / SUM(w) AS {z}' for z in Z)} FROM zed JOIN (SELECT nation, season, i AS uid, unnest([1, 2, 3]) AS c, unnest([u1, u2, u3]) AS w FROM u) USING (nation, season, uid) GROUP BY nation, season, c)"
COST = f"cost AS (SELECT a.nation, a.season, a.cluster AS a, b.cluster AS b, {' + '.join(f'ABS(a.{z} - b.{z})' for z in Z)} AS cost FROM prof a JOIN prof b ON a.nation = b.nation AND b.season = a.season + 1)"
_PERMS = ", ".join(f"({n}, {a + 1}, {b + 1})" for n, p in enumerate(permutations(range(K))) for a, b in enumerate(p))
ASSIGN = f"""perms(perm, a, b) AS (VALUES {_PERMS}),
best AS (SELECT nation, season, arg_min(perm, (total, perm)) AS perm FROM (SELECT nation, season, perm, ROUND(SUM(cost), 9) AS total FROM cost JOIN perms USING (a, b) GROUP BY nation, season, perm HAVING COUNT(*) = {K}) GROUP BY nation, season),
chosen AS (SELECT nation, season, a, b FROM best JOIN perms USING (perm))"""
_SEASONS = list(range(1995, 2002))
LABELS = "lab1995 AS (SELECT nation, 1995 AS season, unnest([1, 2, 3]) AS cluster, unnest([1, 2, 3]) AS label FROM (SELECT DISTINCT nation FROM chosen)),\n" + ",\n".join(
    f"lab{t + 1} AS (SELECT f.nation, {t + 1} AS season, f.b AS cluster, COALESCE(l.label, f.b) AS label FROM (SELECT nation, unnest([1, 2, 3]) AS b FROM (SELECT DISTINCT nation FROM chosen)) f LEFT JOIN (SELECT c.nation, c.b, l.label FROM chosen c JOIN lab{t} l ON c.nation = l.nation AND c.a = l.cluster WHERE c.season = {t}) l ON f.nation = l.nation AND f.b = l.b)"
    for t in _SEASONS[:-1]
) + ",\nlabels AS (" + " UNION ALL ".join(f"SELECT * FROM lab{t}" for t in _SEASONS) + ")"
ALL = (PAIRS, CONST, NEAR, U, ZED, PROF, COST, ASSIGN)


def _profiles(spark: Spark, sf: str, c: DataFrame | None = None, u: DataFrame | None = None) -> DataFrame:
    c = cells(spark, sf) if c is None else c
    z = A.z_scores(c.select(*CELL, "uid", *FEATURES), FEATURES)
    u = (_memberships(spark, sf, c) if u is None else u).select(*CELL, F.col("i").alias("uid"), "u")
    return staged(A.profiles(z.join(u, [*CELL, "uid"]), CELL, "u", K, Z), "profiles")


def _costs(spark: Spark, sf: str, c: DataFrame | None = None, u: DataFrame | None = None) -> DataFrame:
    return A.profile_costs(_profiles(spark, sf, c, u), ["nation"], "season", Z)


def _chosen(spark: Spark, sf: str, c: DataFrame | None = None, u: DataFrame | None = None) -> DataFrame:
    return staged(A.optimal_assignment(_costs(spark, sf, c, u), CELL, K), "assignment")


def _labels(spark: Spark, sf: str, c: DataFrame | None = None, u: DataFrame | None = None) -> DataFrame:
    return staged(A.propagate_labels(_chosen(spark, sf, c, u), ["nation"], "season", 1995, 2001, K), "labels")


def _aligned(spark: Spark, sf: str, c: DataFrame | None = None) -> DataFrame:
    """The cells (given, or made) and their memberships are read by every step, so they are made once."""
    c = cells(spark, sf) if c is None else c
    u = _memberships(spark, sf, c)
    return staged(A.relabel(u.select(*CELL, F.col("i").alias("uid"), "u"), _labels(spark, sf, c, u), CELL, "u", K), "aligned")


ALIGNED = f"""aligned AS (SELECT nation, season, i AS uid, {', '.join(f'MAX(CASE WHEN label = {k} THEN [u1, u2, u3][cluster] END) AS v{k}' for k in range(1, K + 1))}, MAX(u{K + 1}) AS v{K + 1} FROM u JOIN labels USING (nation, season) GROUP BY nation, season, i),
al AS (SELECT *, CASE {' '.join(f'WHEN v{k} = greatest({", ".join(f"v{x}" for x in range(1, K + 2))}) THEN {k}' for k in range(1, K + 2))} END AS hard FROM aligned),
tr AS (SELECT a.uid, a.season, a.nation, {', '.join(f'b.v{k} - a.v{k} AS e{k}' for k in range(1, K + 2))}, {', '.join(f'a.v{k} AS a{k}, b.v{k} AS b{k}' for k in range(1, K + 2))}, a.hard AS hard_t, b.hard AS hard_t1 FROM al a JOIN al b ON a.uid = b.uid AND b.season = a.season + 1)"""


def _transitions(spark: Spark, sf: str, c: DataFrame | None = None) -> DataFrame:
    return A.transitions(_aligned(spark, sf, c), "uid", "season", "u", K)


@add("al1_z_scores", with_base(ZED) + f"SELECT nation, season, uid, {', '.join(f'{r(z)} AS {z}' for z in Z)} FROM zed")
def _(spark: Spark, sf: str) -> DataFrame:
    return A.z_scores(cells(spark, sf), FEATURES).select(*CELL, "uid", *[rounded(z).alias(z) for z in Z])


@add("al2_profiles", with_base(*ALL[:6]) + f"SELECT nation, season, cluster, {', '.join(f'{r(z, 5)} AS {z}' for z in Z)} FROM prof")
def _(spark: Spark, sf: str) -> DataFrame:
    return _profiles(spark, sf).select(*CELL, "cluster", *[rounded(z, 5).alias(z) for z in Z])


@add("al3_costs", with_base(*ALL[:7]) + f"SELECT nation, season, a, b, {r('cost', 5)} AS cost FROM cost")
def _(spark: Spark, sf: str) -> DataFrame:
    return _costs(spark, sf).select(*CELL, "a", "b", rounded("cost", 5).alias("cost"))


@add("al3_medoid_costs", with_base(PAIRS, CONST, NEAR) + f"SELECT a.nation, a.season, a.rn AS a, b.rn AS b, {r(_SQ(f'({_D1})', f'({_D2})', f'({_D3})'), 5)} AS cost FROM med a JOIN med b ON a.nation = b.nation AND b.season = a.season + 1, const")
def _(spark: Spark, sf: str) -> DataFrame:
    c = cells(spark, sf)
    const = D.scaling_constants(D.pair_distances(c, c, CELL, "uid", TYPES))
    out = A.medoid_costs(_medoids(c), ["nation"], "season", "c", TYPES, W, const)
    return out.select(*CELL, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), rounded("cost", 5).alias("cost"))


@add("al4_assignment", with_base(*ALL) + "SELECT nation, season, a, b FROM chosen")
def _(spark: Spark, sf: str) -> DataFrame:
    return _chosen(spark, sf)


@add("al5_labels", with_base(*ALL, LABELS) + "SELECT nation, season, cluster, label FROM labels")
def _(spark: Spark, sf: str) -> DataFrame:
    return _labels(spark, sf).select("nation", "season", "cluster", "label")


@add("al6_ambiguity", with_base(*ALL) + f"""SELECT nation, season, {r('AVG(cost)', 5)} AS mean_d, {r('MAX(cost)', 5)} AS max_d, {r('MIN(alt / NULLIF(cost, 0))', 4)} AS min_ratio, CAST(SUM(CASE WHEN alt / NULLIF(cost, 0) < 1.10 THEN 1 ELSE 0 END) AS BIGINT) AS n_ambiguous
  FROM (SELECT c.nation, c.season, c.cost, (SELECT MIN(o.cost) FROM cost o WHERE o.nation = c.nation AND o.season = c.season AND ((o.a = c.a) <> (o.b = c.b))) AS alt FROM cost c JOIN chosen USING (nation, season, a, b)) GROUP BY nation, season""")
def _(spark: Spark, sf: str) -> DataFrame:
    costs = _costs(spark, sf)
    out = A.match_ambiguity(costs, A.optimal_assignment(costs, CELL, K), CELL)
    return out.select(*CELL, rounded("mean_d", 5).alias("mean_d"), rounded("max_d", 5).alias("max_d"), rounded("min_ratio", 4).alias("min_ratio"), "n_ambiguous")


@add("al7_relabelled", with_base(*ALL, LABELS, ALIGNED) + f"SELECT nation, season, uid, {', '.join(f'{r(f"v{k}", 5)} AS u{k}' for k in range(1, K + 2))}, hard FROM al")
def _(spark: Spark, sf: str) -> DataFrame:
    return _aligned(spark, sf).select(*CELL, "uid", *[rounded(_u(k), 5).alias(f"u{k}") for k in range(1, K + 2)], "hard")


@add("al8_medoid_table", with_base(*ALL, LABELS) + "SELECT m.nation, m.season, l.label, m.uid, m.club_main, m.pos, m.minutes FROM med m JOIN labels l ON m.nation = l.nation AND m.season = l.season AND m.rn = l.cluster")
def _(spark: Spark, sf: str) -> DataFrame:
    med = _medoids(cells(spark, sf)).select(*CELL, F.col("c").alias("cluster"), "uid", "club_main", "pos", "minutes")
    return med.join(_labels(spark, sf), [*CELL, "cluster"]).select(*CELL, "label", "uid", "club_main", "pos", "minutes")


@add("al9_anchor", with_base(*ALL[:6], f"perms(perm, a, b) AS (VALUES {_PERMS})", f"anchored AS (SELECT p.nation, p.season, p.cluster AS a, f.cluster AS b, {' + '.join(f'ABS(p.{z} - f.{z})' for z in Z)} AS cost FROM prof p CROSS JOIN (SELECT cluster, {', '.join(f'AVG({z}) AS {z}' for z in Z)} FROM prof GROUP BY cluster) f)") + f"SELECT nation, season, a, b FROM (SELECT nation, season, arg_min(perm, (total, perm)) AS perm FROM (SELECT nation, season, perm, ROUND(SUM(cost), 9) AS total FROM anchored JOIN perms USING (a, b) GROUP BY ALL HAVING COUNT(*) = {K}) GROUP BY nation, season) JOIN perms USING (perm)")
def _(spark: Spark, sf: str) -> DataFrame:
    prof = _profiles(spark, sf)
    fixed = prof.groupBy("cluster").agg(*[F.avg(z).alias(z) for z in Z])
    return A.anchor(prof, fixed, CELL, Z, K)


@add("al10_consistency", with_base(*ALL, LABELS, ALIGNED) + f"SELECT nation, season, COUNT(*) AS pairs, {r('AVG((hard_t = hard_t1)::INTEGER)')} AS persistence FROM tr WHERE hard_t <= {K} AND hard_t1 <= {K} GROUP BY nation, season")
def _(spark: Spark, sf: str) -> DataFrame:
    nation = cells(spark, sf).select("uid", "season", "nation")
    t = _transitions(spark, sf).where((F.col("hard_t") <= K) & (F.col("hard_t1") <= K)).join(nation, ["uid", "season"])
    return t.groupBy(*CELL).agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg((F.col("hard_t") == F.col("hard_t1")).cast("double"))).alias("persistence"))


_ALIGNED_PROF = [
    f"prof_al AS (SELECT nation, season, c AS cluster, {', '.join(f'SUM(w * {z}) / SUM(w) AS {z}' for z in Z)} FROM zed JOIN (SELECT nation, season, uid, unnest([1, 2, 3]) AS c, unnest([v1, v2, v3]) AS w FROM al) USING (nation, season, uid) GROUP BY nation, season, c)",
    COST.replace("cost AS (", "cost_al AS (", 1).replace("prof a", "prof_al a").replace("prof b", "prof_al b"),
]


@add("al10_identity", with_base(*ALL, LABELS, ALIGNED, *_ALIGNED_PROF) + f"SELECT nation, season, arg_min(perm, (total, perm)) = 0 AS consistent FROM (SELECT nation, season, perm, ROUND(SUM(cost), 9) AS total FROM cost_al JOIN perms USING (a, b) GROUP BY nation, season, perm HAVING COUNT(*) = {K}) GROUP BY nation, season")
def _(spark: Spark, sf: str) -> DataFrame:
    """Is each label, after alignment, still nearest to itself at the next period under the best match of profiles?"""
    z = A.z_scores(cells(spark, sf).select(*CELL, "uid", *FEATURES), FEATURES)
    prof = staged(A.profiles(z.join(_aligned(spark, sf).select(*CELL, "uid", "u"), [*CELL, "uid"]), CELL, "u", K, Z), "profiles")
    return A.identity_matches(A.profile_costs(prof, ["nation"], "season", Z), CELL, K)


@add("al10_medoid_agreement", with_base(*ALL, LABELS) + f"SELECT nation, {r('AVG(share)')} AS agreement FROM (SELECT nation, label, MAX(n) / SUM(n) AS share FROM (SELECT m.nation, l.label, m.pos, COUNT(*) AS n FROM med m JOIN labels l ON m.nation = l.nation AND m.season = l.season AND m.rn = l.cluster GROUP BY ALL) GROUP BY nation, label) GROUP BY nation")
def _(spark: Spark, sf: str) -> DataFrame:
    med = _medoids(cells(spark, sf)).select(*CELL, F.col("c").alias("cluster"), "pos").join(_labels(spark, sf), [*CELL, "cluster"])
    return A.medoid_agreement(med, ["nation"], "label", "pos").select("nation", rounded("agreement").alias("agreement"))


@add("al11_names", with_base(*ALL, LABELS, ALIGNED, "pp AS (SELECT label, SUM(w * s_npg_p90) / SUM(w) AS f1, SUM(w * s_tackles_p90) / SUM(w) AS f2 FROM cells JOIN (SELECT nation, season, uid, unnest([1, 2, 3]) AS label, unnest([v1, v2, v3]) AS w FROM al) USING (nation, season, uid) GROUP BY label)", "n1 AS (SELECT label FROM pp ORDER BY f1 DESC, label LIMIT 1)", "n2 AS (SELECT label FROM pp WHERE label NOT IN (SELECT label FROM n1) ORDER BY f2 DESC, label LIMIT 1)") + "SELECT label, CASE WHEN label IN (SELECT label FROM n1) THEN 'scorers' WHEN label IN (SELECT label FROM n2) THEN 'tacklers' ELSE 'others' END AS name FROM pp")
def _(spark: Spark, sf: str) -> DataFrame:
    x = cells(spark, sf).select(*CELL, "uid", "s_npg_p90", "s_tackles_p90").join(_aligned(spark, sf), [*CELL, "uid"]).withColumn("all", F.lit(1))
    names = A.name_by_profile(A.profiles(x, ["all"], "u", K, ["s_npg_p90", "s_tackles_p90"]), [("s_npg_p90", "scorers"), ("s_tackles_p90", "tacklers")], "others")
    return spark.createDataFrame(sorted(names.items()), "label int, name string")


# -- transitions -------------------------------------------------------------------------------------------------------------------

T_ALL = (*ALL, LABELS, ALIGNED)
_H = lambda s: "-(" + " + ".join(f"least(greatest({s}{k}, 1e-12::DOUBLE), 1) * ln(least(greatest({s}{k}, 1e-12::DOUBLE), 1))" for k in range(1, K + 2)) + ")"


@add("tr1_delta_memberships", with_base(*T_ALL) + f"SELECT uid, season, {', '.join(f'{r(f"e{k}", 5)} AS d{k}' for k in range(1, K + 2))} FROM tr")
def _(spark: Spark, sf: str) -> DataFrame:
    return _transitions(spark, sf).select("uid", "season", *[rounded(F.element_at("delta", k), 5).alias(f"d{k}") for k in range(1, K + 2)])


@add("tr2_norm_entropy", with_base(*T_ALL) + f"SELECT uid, season, {r('sqrt(e1 * e1 + e2 * e2 + e3 * e3)', 5)} AS norm, {r(_H('a'), 5)} AS h0, {r(_H('b'), 5)} AS h1 FROM tr")
def _(spark: Spark, sf: str) -> DataFrame:
    return _transitions(spark, sf).select("uid", "season", rounded("transition_norm", 5).alias("norm"), rounded("entropy_t", 5).alias("h0"), rounded("entropy_t1", 5).alias("h1"))


@add("tr3_persistence", with_base(*T_ALL) + f"SELECT {r('AVG((hard_t = hard_t1)::INTEGER)')} AS persistence, COUNT(*) AS pairs FROM tr WHERE hard_t <= {K} AND hard_t1 <= {K}")
def _(spark: Spark, sf: str) -> DataFrame:
    return A.persistence(_transitions(spark, sf), K).select(rounded("persistence").alias("persistence"), "pairs")


@add("tr4_transition_matrix", with_base(*T_ALL) + f"SELECT x.k AS hard_t, y.k AS hard_t1, COUNT(tr.uid) AS pairs, {r('COUNT(tr.uid) / NULLIF(SUM(COUNT(tr.uid)) OVER (PARTITION BY x.k), 0)')} AS share FROM (SELECT CAST(unnest(range(1, {K + 2})) AS INTEGER) AS k) x CROSS JOIN (SELECT CAST(unnest(range(1, {K + 2})) AS INTEGER) AS k) y LEFT JOIN tr ON tr.hard_t = x.k AND tr.hard_t1 = y.k GROUP BY x.k, y.k")
def _(spark: Spark, sf: str) -> DataFrame:
    return A.transition_matrix(_transitions(spark, sf), K).withColumn("share", rounded("share"))


@add("tr5_prevalence", with_base(*T_ALL) + f"SELECT season, {', '.join(f'{r(f"AVG(v{k})", 5)} AS u{k}' for k in range(1, K + 2))} FROM al GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    return _aligned(spark, sf).groupBy("season").agg(*[rounded(F.avg(_u(k)), 5).alias(f"u{k}") for k in range(1, K + 2)])


@add("tr6_trajectories", with_base(*T_ALL) + f"SELECT uid, season, hard, {r('v1', 5)} AS u1 FROM al QUALIFY COUNT(*) OVER (PARTITION BY uid) >= 3")
def _(spark: Spark, sf: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    return _aligned(spark, sf).withColumn("n", n).where("n >= 3").select("uid", "season", "hard", rounded(_u(1), 5).alias("u1"))


@add("ag10_weighted_means", with_base(*ALL[:4]) + f"SELECT season, c AS cluster, {r('SUM(w * minutes) / SUM(w)', 4)} AS minutes, {r('SUM(w * sot_rate) / SUM(w)', 5)} AS sot_rate FROM cells JOIN (SELECT nation, season, i AS uid, unnest([1, 2, 3]) AS c, unnest([u1, u2, u3]) AS w FROM u) USING (nation, season, uid) GROUP BY season, c")
def _(spark: Spark, sf: str) -> DataFrame:
    x = cells(spark, sf).join(_memberships(spark, sf).select(*CELL, F.col("i").alias("uid"), "u"), [*CELL, "uid"])
    return A.profiles(x, ["season"], "u", K, ["minutes", "sot_rate"]).select("season", "cluster", rounded("minutes", 4).alias("minutes"), rounded("sot_rate", 5).alias("sot_rate"))


