"""Exact sums and extremes over all pairs of a cell's rows without forming the pairs: sorted prefix sums, dominance sums and counts of label patterns."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import Types, jaccard_matrix


class Dominance:
    """For points (a, b): sums of any weights over the points that come before in both orders, in n log n steps; the orders are kept, so further weights are cheap."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(a)
        self.n, self.by_a, self.by_b = n, np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        place = np.empty(n, np.int64)
        place[self.by_a] = np.arange(n)
        by_b = place[self.by_b]  # places in the order of a, by b
        self.levels = []
        for level in range(max(0, n - 1).bit_length()):
            order = by_b[np.argsort((by_b >> (level + 1)).astype(np.uint16 if n < 1 << 17 else np.int64), kind="stable")]
            self.levels.append(order.astype(np.int32 if n < 1 << 31 else np.int64))

    def before(self, v: np.ndarray) -> np.ndarray:
        """(n, c): sums of v (n, c) over the points before each in both orders."""
        x, out = v[self.by_a], np.zeros_like(v)
        for level, order in enumerate(self.levels):  # blocks of the order of a, two by two: what a left one adds to its right one
            rows = np.flatnonzero(order >> level & 1)
            run = x[order]
            run[rows] = 0.0
            np.cumsum(run, 0, out=run)
            first = rows >> (level + 1) << (level + 1)  # a pair of blocks holds the places from its start on, in this order too
            out[order[rows]] += run[rows] - np.where(first[:, None] > 0, run[first - 1], 0.0)
        back = np.empty_like(out)
        back[self.by_a] = out
        return back

    def signed(self, v: np.ndarray) -> np.ndarray:
        """(n, c): sums of v, with the sign of the product of both differences; points that tie in one order may take either sign."""
        prefix = np.empty((2, *v.shape))
        for out, order in zip(prefix, (self.by_a, self.by_b)):
            out[order] = np.cumsum(v[order], 0) - v[order]
        return 4 * self.before(v) - 2 * prefix[0] - 2 * prefix[1] + v.sum(0)


class Manhattan:
    """Weighted sums of Manhattan distances, and of their squares, from every row of x to all rows."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x - x.mean(0) if len(x) else x
        self.pairs = [(p, q, Dominance(x[:, p], x[:, q])) for p, q in combinations(range(x.shape[1]), 2)]

    def sums(self, w: np.ndarray) -> np.ndarray:
        """(n, c): sum over j of w[j, c] |x_i - x_j|."""
        out = np.zeros_like(w)
        for a in self.x.T:
            order = np.argsort(a, kind="stable")
            s, t = np.cumsum(w[order], 0), np.cumsum(w[order] * a[order, None], 0)
            out[order] += a[order, None] * (2 * s - s[-1]) - (2 * t - t[-1])
        return out

    def squares(self, w: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """(n, c): sum over j of w[j, c] |x_i - x_j| squared; `most` numbers are held at a time."""
        step = max(1, most // max(1, 16 * len(w)))
        if w.shape[1] > step:
            return np.concatenate([self.squares(w[:, i : i + step]) for i in range(0, w.shape[1], step)], 1)
        total, out = w.sum(0), np.zeros_like(w)
        for a in self.x.T:
            out += total * (a * a)[:, None] - 2 * a[:, None] * (a @ w) + (a * a) @ w
        for p, q, order in self.pairs:
            a, b = self.x[:, p, None], self.x[:, q, None]
            s, sb, sa, sab = np.split(order.signed(np.concatenate((w, w * b, w * a, w * a * b), 1)), 4, 1)
            out += 2 * (a * b * s - a * sb - b * sa + sab)
        return np.maximum(out, 0.0)

    def widest(self) -> float:
        """Largest distance of two rows: the widest spread along a vector of signs."""
        if not len(self.x):
            return 0.0
        signs = np.array([(1, *s) for s in product((1, -1), repeat=self.x.shape[1] - 1)], float)
        along = self.x @ signs.T
        return float((along.max(0) - along.min(0)).max())


class Labels:
    """Jaccard distances by the distinct label patterns, of which there are few."""

    def __init__(self, x: np.ndarray) -> None:
        self.patterns, own = np.unique(x, axis=0, return_inverse=True)
        self.own, self.matrix = own.ravel(), jaccard_matrix(self.patterns)

    def _sums(self, matrix: np.ndarray, w: np.ndarray) -> np.ndarray:
        order = np.argsort(self.own, kind="stable")
        by = np.add.reduceat(w[order], np.searchsorted(self.own[order], np.arange(len(self.patterns))), 0)
        return (matrix @ by)[self.own]

    def sums(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.matrix, w)

    def squares(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.matrix**2, w)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each distinct row, in their order; the distinct row of every row; how many rows each has)."""
    if not len(x):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    plain = np.ascontiguousarray(x + 0.0)  # no negative zeros, so equal rows have equal bytes
    keys = plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel()
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    return first[order], rank[inverse.ravel()], counts[order]


def pair_facts(df: DataFrame, cell: list[str], types: Types, more: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """(cell, pairs, and for each type k: n{k} pairs with a distance, s{k} and q{k} sums of distances and squares, m{k} the largest). more: further groups of columns, in Manhattan distance, as types 4 and on. A cell is one task, in n log n steps; a distance lacks where a column is null."""
    groups = (types.performance, types.rates, types.labels, *more)
    places = range(1, len(groups) + 1)

    def run(table: pa.Table) -> pa.Table:
        out = [table.column(c).slice(0, 1) for c in cell] + [pa.array([len(table) * (len(table) - 1) // 2], pa.int64())]
        for k, cols in enumerate(groups):
            x = np.stack([table.column(c).to_numpy().astype(float) for c in cols], 1)
            x = x[~np.isnan(x).any(1)]
            n, (first, _, counts) = len(x), distinct(x)
            of, w = (Labels if k == 2 else Manhattan)(x[first]) if n else None, counts.astype(float)[:, None]
            s, q = (float(w[:, 0] @ of.sums(w)[:, 0]) / 2, float(w[:, 0] @ of.squares(w)[:, 0]) / 2) if n > 1 else (0.0, 0.0)
            most = None if n < 2 else float(of.matrix.max()) if k == 2 else of.widest()
            out += [pa.array([n * (n - 1) // 2], pa.int64()), pa.array([s]), pa.array([q]), pa.array([most], pa.float64())]
        return pa.Table.from_arrays(out, names)

    kinds, names = dict(df.dtypes), [*cell, "pairs", *[f"{c}{k}" for k in places for c in "nsqm"]]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cell) + ", pairs long, " + ", ".join(f"n{k} long, s{k} double, q{k} double, m{k} double" for k in places)
    return df.select(*cell, *dict.fromkeys(c for g in groups for c in g)).groupBy(*cell).applyInArrow(run, schema)


def constants_from(facts: DataFrame, rule: str = "max", at: tuple[int, int, int] = (1, 2, 3)) -> DataFrame:
    """One row (c1, c2, c3), as `scaling_constants` of all pairs. at: the places of the types in `facts`."""
    if rule == "max":
        return facts.agg(F.max(f"m{at[0]}").alias("c1"), F.max(f"m{at[1]}").alias("c2"), F.lit(1.0).alias("c3"))

    def of(k: int) -> Column:
        n = F.nullif(F.sum(f"n{k}"), F.lit(0))
        mean = F.sum(f"s{k}") / n
        return mean if rule == "mean" else F.sqrt(F.greatest(F.sum(f"q{k}") / n - mean * mean, F.lit(0.0)))

    return facts.agg(*[of(k).alias(f"c{i + 1}") for i, k in enumerate(at)])


def least_cost(df: DataFrame, cell: list[str], ident: str, types: Types, um: str, weights: list[float], constants: tuple[float, float, float], digits: int = 9) -> DataFrame:
    """(cell, medoid): the row of least summed um times combined squared distance to all rows of its cell, costs rounded, the least id on ties. Equal rows have one cost."""
    kinds = dict(df.dtypes)
    groups = (types.performance, types.rates, types.labels)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ident)
        x = [np.stack([table.column(c).to_numpy().astype(float) for c in cols], 1) for cols in groups]
        first, own, _ = distinct(np.concatenate(x, 1))
        w, cost = np.bincount(own, table.column(um).to_numpy().astype(float))[:, None], np.zeros(len(first))
        for k, block in enumerate(x):
            cost += (weights[k] / constants[k]) ** 2 * (Labels if k == 2 else Manhattan)(block[first]).squares(w)[:, 0]
        at = int(first[np.round(cost, digits).argmin()])
        return pa.Table.from_arrays([*[table.column(c).slice(0, 1) for c in cell], table.column(ident).slice(at, 1)], [*cell, "medoid"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cell) + f", medoid {kinds[ident]}"
    return df.select(*cell, ident, um, *types.columns).groupBy(*cell).applyInArrow(run, schema)
