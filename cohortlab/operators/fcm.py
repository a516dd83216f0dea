"""Robust fuzzy c-medoids with a noise cluster on mixed-type distances: expressions for single steps, and whole fits a cell at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .distance import Types, jaccard_matrix, l1_matrix
from .pairsums import Labels, Manhattan, distinct

LEAST = 1e-12


@dataclass(frozen=True)
class FitConfig:
    """Settings of a fit. weights: fixed type weights, or None to estimate them (with `weight_floor`)."""

    k: int = 4
    m: float = 1.3
    rho: float = 1.0
    starts: int = 10
    seed: int = 0
    noise_rule: str = "mean"
    weights: tuple[float, ...] | None = None
    weight_floor: float = 0.0
    most_rounds: int = 200


# -- single steps as expressions ------------------------------------------------------------------------------------------------


def memberships(distances: Sequence[Column], noise: Column, m: float) -> list[Column]:
    """Membership of each medoid and, last, of noise, from squared distances: shares of d2^(-1/(m-1)), shifted by the largest logit."""
    logits = [-F.log(F.greatest(d, F.lit(LEAST))) / (m - 1) for d in (*distances, noise)]
    top = F.greatest(*logits)
    weights = [F.exp(x - top) for x in logits]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def noise_distance(rho: float, d2: Column, um: Column | None = None, n_k: Column | None = None) -> Column:
    """rho times the mean squared distance to the medoids, or, given u^m, times their weighted sum over n * K (aggregates)."""
    return rho * F.avg(d2) if um is None else rho * F.sum(um * d2) / n_k


def type_weights(um: Column, squares: Sequence[Column], floor: float = 0.0) -> list[Column]:
    """Type weights in inverse proportion to each type's share of the objective (aggregates)."""
    inverse = [1 / (F.sum(um * s) + LEAST) for s in squares]
    total = sum(inverse[1:], inverse[0])
    return [floor + (1 - len(inverse) * floor) * x / total for x in inverse]


# -- fits -------------------------------------------------------------------------------------------------------------------------


@dataclass
class Fit:
    u: np.ndarray
    medoids: list[int]
    weights: np.ndarray
    noise: float
    rounds: int
    converged: bool
    objective: float
    xie_beni: float
    stability: float = float("nan")

    @property
    def labels(self) -> np.ndarray:
        """Place of the largest membership; K stands for noise."""
        return self.u.argmax(1)


class Distances:
    """Squared scaled distances between the distinct rows of a cell, by type: matrices up to `most_kept` distinct rows, else sums from sorted orders and single columns as they are needed.

    Equal rows are held once, with their number; `own` is the distinct row of each row.
    """

    def __init__(self, n: int, kept: list[np.ndarray] | None = None, blocks: list[np.ndarray] | None = None, scales: tuple[float, ...] = (), copies: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, most_whole: int = 0):
        self.n, self.kept, self.blocks, self.scales, self.most_whole = n, kept, blocks, scales, most_whole
        self.first, self.own, self.counts = copies if copies is not None else (np.arange(n), np.arange(n), np.ones(n, int))
        self.rows, self.starts = np.argsort(self.own, kind="stable"), np.cumsum(self.counts) - self.counts  # rows of each distinct row, in order
        self.types = len(kept) if kept is not None else len(blocks)
        self._whole: tuple[bytes, np.ndarray] | None = None
        self._sums: list | None = None
        self._seeds: dict = {}

    @staticmethod
    def of(x: dict[str, np.ndarray], types: Types, constants: tuple[float, float, float], most_kept: int = 1500) -> Distances:
        blocks = [np.stack([x[c] for c in cols], 1).astype(float) for cols in (types.performance, types.rates, types.labels)]
        n, copies = len(blocks[0]), distinct(np.concatenate(blocks, 1))
        blocks = [b[copies[0]] for b in blocks]
        out = Distances(n, None, blocks, tuple(c if c else 1.0 for c in constants), copies, most_kept * 8 // 3)
        if len(copies[0]) <= most_kept:
            out.kept = out.columns(copies[0])
        return out

    def columns(self, at: np.ndarray) -> list[np.ndarray]:
        """(len(at), distinct rows) of each type: from rows to all distinct rows."""
        at = self.own[at]
        if self.kept is not None:
            return [s[at] for s in self.kept]
        a, b, c = self.blocks
        step = max(1, (1 << 21) // max(1, a.size, b.size))
        raw = l1_matrix(a[at], a, step), l1_matrix(b[at], b, step), jaccard_matrix(c[at], c)
        return [(m / s) ** 2 for m, s in zip(raw, self.scales)]

    def whole(self, weights: np.ndarray) -> np.ndarray | None:
        """The matrix of combined squared distances, if it is small enough to be kept."""
        if self.kept is None and len(self.first) > self.most_whole:
            return None
        if self._whole is None or self._whole[0] != weights.tobytes():
            m, w = len(self.first), weights**2
            out = np.empty((m, m))
            for i in range(0, m, 256):
                out[i : i + 256] = sum(x * s for x, s in zip(w, self.columns(self.first[i : i + 256])))
            self._whole = weights.tobytes(), out
        return self._whole[1]

    def near(self, medoids: np.ndarray, weights: np.ndarray, fixed: bool) -> np.ndarray:
        """(starts, k, distinct rows): combined squared distances to medoids (starts, k), under weights (starts, types)."""
        if fixed and (whole := self.whole(weights[0])) is not None:
            return whole[self.own[medoids]]
        return sum(weights[:, t, None, None] ** 2 * s.reshape(*medoids.shape, -1) for t, s in enumerate(self.columns(medoids.ravel())))

    def cost(self, um: np.ndarray, weights: np.ndarray, fixed: bool) -> np.ndarray:
        """Combined squared distances times um (starts, k, distinct rows), under weights (starts, types)."""
        flat = um.reshape(-1, um.shape[2])
        if fixed and (whole := self.whole(weights[0])) is not None:
            return (flat @ whole).reshape(um.shape)
        if self.kept is None and self._sums is None:
            self._sums = [Manhattan(self.blocks[0]), Manhattan(self.blocks[1]), Labels(self.blocks[2])]
        each = (flat @ s for s in self.kept) if self.kept is not None else (x.squares(np.ascontiguousarray(flat.T)).T / c**2 for x, c in zip(self._sums, self.scales))
        return sum(weights[:, t, None, None] ** 2 * s.reshape(um.shape) for t, s in enumerate(each))

    def seeds(self, weights: np.ndarray, k: int, seed: int) -> list[int]:
        """Seeds of a start; fits that differ in other settings share them, and those of a larger K begin with those of a smaller one."""
        at = weights.tobytes(), seed
        if at not in self._seeds:
            self._seeds[at] = [], np.random.default_rng(seed), np.full(len(self.first), np.inf)
        return _extend(self, weights, k, *self._seeds[at])[:k]


def _extend(distances: Distances, weights: np.ndarray, k: int, chosen: list[int], rng: np.random.Generator, least: np.ndarray) -> list[int]:
    while len(chosen) < k:
        if not chosen:
            chosen.append(int(rng.integers(distances.n)))
        else:
            mass = least[distances.own]
            mass[chosen] = 0.0
            if mass.sum() <= 0:  # only copies of the chosen are left
                mass = np.ones(distances.n)
                mass[chosen] = 0.0
            share = np.cumsum(mass / mass.sum())
            chosen.append(int(np.searchsorted(share / share[-1], rng.random(), side="right")))
        np.minimum(least, distances.near(np.array([chosen[-1:]]), weights[None], True)[0, 0], out=least)
    return chosen


def seed_medoids(distances: Distances, weights: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """The first at random, each other in proportion to the squared distance to the nearest chosen; never one twice."""
    return _extend(distances, weights, k, [], rng, np.full(len(distances.first), np.inf))


def _logits(near: np.ndarray, noise: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the memberships of the medoids (starts, k, rows) and of noise (starts, rows)."""
    own = -np.log(np.maximum(near, LEAST)) / (power - 1)[:, None, None]
    other = (-np.log(np.maximum(noise, LEAST)) / (power - 1))[:, None]
    top = np.maximum(own.max(1), other)
    own -= top[:, None]
    other = other - top
    total = np.log(np.exp(own).sum(1) + np.exp(other))
    own -= total[:, None]
    return own, other - total


def _fit_side_by_side(distances: Distances, runs: list[tuple[FitConfig, int]]) -> list[Fit]:
    """Fits of (settings, seed) that agree in all but m, rho and seeds; memberships are those of the distinct rows."""
    config, n, counts, count = runs[0][0], distances.n, distances.counts.astype(float), len(runs)
    k, types, fixed = config.k, distances.types, config.weights is not None
    power, rho = np.array([c.m for c, _ in runs]), np.array([c.rho for c, _ in runs])
    weights = np.tile(np.asarray(config.weights) / np.sum(config.weights) if fixed else np.full(types, 1 / types), (count, 1))
    medoids = np.array([distances.seeds(weights[0], k, s) for _, s in runs])
    noise = rho * (distances.near(medoids, weights, fixed) @ counts).sum(1) / (n * k)
    rounds, live = np.zeros(count, int), np.arange(count)
    while len(live) and rounds.max() < config.most_rounds:
        rounds[live] += 1
        near = distances.near(medoids[live], weights[live], fixed)
        um = np.exp(_logits(near, noise[live], power[live])[0] * power[live, None, None]) * counts
        if not fixed:
            columns = distances.columns(medoids[live].ravel())
            inverse = 1 / np.stack([(um * c.reshape(um.shape)).sum((1, 2)) + LEAST for c in columns], 1)
            weights[live] = config.weight_floor + (1 - types * config.weight_floor) * inverse / inverse.sum(1, keepdims=True)
            near = distances.near(medoids[live], weights[live], fixed)
        noise[live] = rho[live] * ((um * near).sum((1, 2)) if config.noise_rule == "weighted" else (near @ counts).sum(1)) / (n * k)
        cost, new, which = distances.cost(um, weights[live], fixed), np.empty((len(live), k), int), np.arange(len(live))
        rows = np.empty_like(new)
        for c in range(k):  # one after the other, since a row is the medoid of one cluster only
            for d in range(c):
                full = (new[:, :c] == new[:, d, None]).sum(1) >= distances.counts[new[:, d]]
                cost[which[full], c, new[full, d]] = np.inf
            new[:, c] = cost[:, c].argmin(1)
            rows[:, c] = distances.rows[distances.starts[new[:, c]] + (new[:, :c] == new[:, c, None]).sum(1)]
        same = (rows == medoids[live]).all(1)
        medoids[live] = rows
        live = live[~same]
    near = distances.near(medoids, weights, fixed)
    own, other = _logits(near, noise, power)
    inner = ((np.exp(own * power[:, None, None]) * near) @ counts).sum(1)
    outer = (np.exp(other * power[:, None]) @ counts) * noise
    u, out, open_ = np.concatenate((np.exp(own), np.exp(other)[:, None]), 1), [], set(live.tolist())
    for i in range(count):
        between = near[i][:, distances.own[medoids[i]]][~np.eye(k, dtype=bool)]
        least = between.min() if k > 1 else 0.0
        out.append(Fit(u[i].T, medoids[i].tolist(), weights[i], float(noise[i]), int(rounds[i]), i not in open_, float(inner[i] + outer[i]), float(inner[i]) / (n * least) if least > 0 else float("inf")))
    return out


def _fit_runs(distances: Distances, runs: list[tuple[FitConfig, int]], most: int = 1 << 20) -> list[Fit]:
    """Fits of all (settings, seed): those that agree in all but m, rho and seeds side by side, `most` memberships at a time."""
    alike: dict = {}
    for i, (c, _) in enumerate(runs):
        alike.setdefault((c.k, c.weights, c.noise_rule, c.weight_floor, c.most_rounds), []).append(i)
    out: list = [None] * len(runs)
    for (k, *_), own in alike.items():
        step = max(1, most // max(1, k * len(distances.first)))
        for i in range(0, len(own), step):
            for at, fit in zip(own[i : i + step], _fit_side_by_side(distances, [runs[j] for j in own[i : i + step]])):
                out[at] = fit
    return out


def fit_starts(distances: Distances, config: FitConfig, seeds: list[int]) -> list[Fit]:
    """A fit from each seed, all side by side: alternate memberships, type weights, noise distance and medoids until the list of medoids stays."""
    out = _fit_runs(distances, [(config, s) for s in seeds])
    for fit in out:
        fit.u = fit.u[distances.own]
    return out


def adjusted_rand(a: np.ndarray, b: np.ndarray, counts: np.ndarray | None = None) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1 if counts is None else counts)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, rows, cols, total = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum()[None])
    expected = rows * cols / total if total else 0.0
    most = (rows + cols) / 2
    return 1.0 if most == expected else float((both - expected) / (most - expected))


def _best(distances: Distances, configs: list[FitConfig]) -> list[Fit]:
    """Of each setting the start of the least objective, the first on ties, with its mean adjusted Rand index to the other starts; memberships are those of the distinct rows."""
    runs, at, out = _fit_runs(distances, [(c, c.seed + i) for c in configs for i in range(c.starts)]), 0, []
    for c in configs:
        own, at = runs[at : at + c.starts], at + c.starts
        best = min(range(len(own)), key=lambda i: own[i].objective)
        labels = [r.labels for r in own]
        rest = [adjusted_rand(labels[best], x, distances.counts) for i, x in enumerate(labels) if i != best]
        own[best].stability = float(np.mean(rest)) if rest else float("nan")
        out.append(own[best])
    return out


def fit_best(distances: Distances, config: FitConfig) -> Fit:
    """The start of the least objective, the first on ties, with its mean adjusted Rand index to the other starts."""
    fit = _best(distances, [config])[0]
    fit.u = fit.u[distances.own]
    return fit


def degenerate(fit: Fit, counts: np.ndarray | None = None) -> bool:
    """One type rules, clusters coincide, or most is noise."""
    return bool(fit.weights.max() > 0.8 or fit.xie_beni < 1e-6 or np.average(fit.labels == fit.u.shape[1] - 1, weights=counts) > 0.5)


_FACTS = "k int, u array<double>, hard int, medoid_of int, objective double, xie_beni double, stability double, rounds int, converged boolean, degenerate boolean, weights array<double>"


def fit_cells(df: DataFrame, cell: list[str], ident: str, types: Types, configs: dict[str, FitConfig], constants: tuple[float, float, float], most_kept: int = 1500) -> DataFrame:
    """One row for each cell, config and member: memberships, hard label, whether it is a medoid, and the facts of the fit.

    A cell is one task, in which distances and seeds serve all configs. Up to most_kept distinct rows distances are kept as matrices; a larger cell takes their sums from sorted orders, so time and memory grow
    with the cell's rows (and a logarithm), not their square. Rows are ordered by `ident` first, so results don't depend on the partitioning. Cells with too few rows for K medoids give none.
    """
    names = [*cell, ident, "config", *[x.split(" ")[0] for x in _FACTS.split(", ")]]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ident)
        n = len(table)
        distances = Distances.of({c: table.column(c).to_numpy().astype(float) for c in types.columns}, types, constants, most_kept)
        out, held = [], {name: c for name, c in configs.items() if n > c.k}
        own = pa.array(distances.own)
        for (name, config), fit in zip(held.items(), _best(distances, list(held.values()))):
            medoid_of = np.zeros(n, np.int32)
            medoid_of[fit.medoids] = np.arange(1, config.k + 1)
            same = lambda x, t, n=n: pa.repeat(pa.scalar(x, t), n)
            lists = lambda x, at: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())).take(at)
            facts = [
                same(config.k, pa.int32()), lists(fit.u, own), pa.array(fit.labels + 1, pa.int32()).take(own), pa.array(medoid_of), same(fit.objective, pa.float64()), same(fit.xie_beni, pa.float64()), same(fit.stability, pa.float64()),
                same(fit.rounds, pa.int32()), same(fit.converged, pa.bool_()), same(degenerate(fit, distances.counts), pa.bool_()), lists(fit.weights[None], pa.array(np.zeros(n, np.int64))),
            ]
            out.append(pa.Table.from_arrays([*(table.column(c) for c in (*cell, ident)), same(name, pa.string()), *facts], names))
        return pa.concat_tables(out) if out else empty

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*cell, ident]) + ", config string, " + _FACTS
    empty = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema).empty_table()
    return df.select(*cell, ident, *types.columns).groupBy(*cell).applyInArrow(run, schema)


def fit_and_reduce(df: DataFrame, cell: list[str], ident: str, types: Types, configs: dict[str, FitConfig], constants: tuple[float, float, float], fields: str, of: Callable[[pa.Table, Distances, FitConfig, Fit], list[Sequence]], more: Sequence[str] = (), most_kept: int = 1500) -> DataFrame:
    """(cell, config, fields): what `of` gives, one list of values a field, for each cell and config, of the fits that `fit_cells` gives row by row; so no row a member and setting is made.

    of: (the cell's rows by `ident`, with the columns `more`; distances; settings; fit with the memberships of the distinct rows).
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cell) + ", config string, " + fields
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ident)
        held = {name: c for name, c in configs.items() if len(table) > c.k}
        distances, out = Distances.of({c: table.column(c).to_numpy().astype(float) for c in types.columns}, types, constants, most_kept), []
        for (name, config), fit in zip(held.items(), _best(distances, list(held.values()))):
            values = of(table, distances, config, fit)
            n = len(values[0])
            at = pa.array(np.zeros(n, np.int64))
            out.append(pa.Table.from_arrays([*(table.column(c).take(at) for c in cell), pa.array([name] * n, pa.string()), *[pa.array(v, f.type) for v, f in zip(values, list(arrow)[len(cell) + 1 :])]], arrow.names))
        return pa.concat_tables(out) if out else arrow.empty_table()

    return df.select(*dict.fromkeys([*cell, ident, *types.columns, *more])).groupBy(*cell).applyInArrow(run, schema)


_CELL_FACTS = "k int, n long, sizes array<long>, n_crisp long, xie_beni double, stability double, degenerate boolean, weights array<double>"


def fit_facts(df: DataFrame, cell: list[str], ident: str, types: Types, configs: dict[str, FitConfig], constants: tuple[float, float, float]) -> DataFrame:
    """One row for each cell and config: rows, rows of each hard label (noise last), rows with a membership of 0.7 or more, and the facts of the fit."""

    def of(table: pa.Table, distances: Distances, config: FitConfig, fit: Fit) -> list[Sequence]:
        sizes = np.bincount(fit.labels, distances.counts, config.k + 1).astype(int).tolist()
        crisp = int(distances.counts[~(fit.u[:, : config.k].max(1) < 0.7)].sum())
        return [[config.k], [len(table)], [sizes], [crisp], [fit.xie_beni], [fit.stability], [degenerate(fit, distances.counts)], [fit.weights.tolist()]]

    return fit_and_reduce(df, cell, ident, types, configs, constants, _CELL_FACTS, of)


def facts_diagnostics(facts: DataFrame) -> DataFrame:
    """`fit_diagnostics`, from the rows of `fit_facts`: means over members are weighted by the cells' rows."""
    mean = lambda c, ok: F.sum(F.when(ok, F.col(c) * F.col("n"))) / F.nullif(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    noise, least = F.element_at("sizes", -1), F.array_min(F.filter(F.slice("sizes", F.lit(1), F.col("k")), lambda x: x > 0))
    out = facts.groupBy("config").agg(
        (F.sum(noise) / F.sum("n")).alias("noise_share"), (F.sum("n_crisp") / F.sum("n")).alias("crisp"), mean("xie_beni", F.col("xie_beni") < float("inf")).alias("xie_beni"),
        mean("stability", ~F.isnan("stability")).alias("stability"), F.max(F.col("degenerate").cast("int")).alias("any_degenerate"), F.min(least).alias("min_size"),
    )
    return out.where("min_size is not null")


def fit_diagnostics(members: DataFrame, cell: list[str]) -> DataFrame:
    """Per config: share of noise, share with a membership of 0.7 or more, least cluster size, mean Xie-Beni index and stability. K of a config is the number of memberships less that of noise."""
    k = F.size("u") - 1
    sizes = members.where(F.col("hard") <= k).groupBy("config", *cell, "hard").agg(F.count(F.lit(1)).alias("n")).groupBy("config").agg(F.min("n").alias("min_size"))
    crisp = F.array_max(F.slice("u", F.lit(1), k)) >= 0.7
    main = members.groupBy("config").agg(F.avg((F.col("hard") == k + 1).cast("double")).alias("noise_share"), F.avg(crisp.cast("double")).alias("crisp"), F.avg(F.when(F.col("xie_beni") < float("inf"), F.col("xie_beni"))).alias("xie_beni"), F.avg(F.nanvl("stability", F.lit(None).cast("double"))).alias("stability"), F.max(F.col("degenerate").cast("int")).alias("any_degenerate"))
    return main.join(sizes, "config")


def adjusted_rand_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labellings, from their contingency counts."""
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2.0
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    side = lambda key, name: counts.groupBy(key).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(name))
    every = counts.agg(F.sum(two("n")).alias("both"), F.sum("n").alias("n")).withColumn("total", two("n")).drop("n")
    row = every.crossJoin(side(a, "rows")).crossJoin(side(b, "cols"))  # three rows of one
    expected, most = F.col("rows") * F.col("cols") / F.nullif("total", F.lit(0.0)), (F.col("rows") + F.col("cols")) / 2
    return row.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"))
