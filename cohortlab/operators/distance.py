"""Mixed-type distances between rows of a cell: Manhattan on scaled numbers, Jaccard on 0/1 labels, and their weighting."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Types:
    """Columns of the three attribute types."""

    performance: tuple[str, ...]
    rates: tuple[str, ...]
    labels: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [*self.performance, *self.rates, *self.labels]

    def weights(self) -> list[float]:
        """Fixed weights of the types, in proportion to the square roots of their numbers of variables."""
        root = [len(x) ** 0.5 for x in (self.performance, self.rates, self.labels)]
        return [x / sum(root) for x in root]


def manhattan(columns: tuple[str, ...], a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in columns])


def jaccard(columns: tuple[str, ...], a: str, b: str) -> Column:
    """1 - shared / united labels; two empty sets are alike."""
    total = lambda side: reduce(lambda x, y: x + y, [F.col(f"{side}{c}") for c in columns])
    shared = reduce(lambda x, y: x + y, [F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in columns])
    united = total(a) + total(b) - shared
    return F.when(united > 0, 1 - shared / united).otherwise(F.lit(0.0))


def pair_distances(left: DataFrame, right: DataFrame, cell: list[str], ident: str, types: Types, ordered: bool = True) -> DataFrame:
    """(cell, i, j, d1, d2, d3) of the pairs within a cell; ordered keeps i < j only. The join key is the cell, so its size bounds the pairs."""
    side = lambda df, p, name: df.select(*cell, F.col(ident).alias(name), *[F.col(c).alias(f"{p}{c}") for c in types.columns])
    pairs = side(left, "a_", "i").join(side(right, "b_", "j"), cell)
    if ordered:
        pairs = pairs.where("i < j")
    return pairs.select(*cell, "i", "j", manhattan(types.performance, "a_", "b_").alias("d1"), manhattan(types.rates, "a_", "b_").alias("d2"), jaccard(types.labels, "a_", "b_").alias("d3"))


def scaling_constants(pairs: DataFrame, rule: str = "max") -> DataFrame:
    """One row (c1, c2, c3): divisors of the three distances, from all pairs i < j: `max` (1 for Jaccard), `mean` or `sd` (population)."""
    if rule == "max":
        return pairs.agg(F.max("d1").alias("c1"), F.max("d2").alias("c2"), F.lit(1.0).alias("c3"))
    f = {"mean": F.avg, "sd": F.stddev_pop}[rule]
    return pairs.agg(*[f(f"d{k}").alias(f"c{k}") for k in (1, 2, 3)])


def combined_squared(weights: list[float]) -> Column:
    """sum of (weight * scaled distance) squared, of columns d1..d3."""
    return reduce(lambda x, y: x + y, [F.pow(F.lit(w) * F.col(f"d{k + 1}"), 2.0) for k, w in enumerate(weights)])


def scaled(pairs: DataFrame, constants: DataFrame) -> DataFrame:
    out = pairs.crossJoin(F.broadcast(constants))  # constants is one row
    return out.withColumns({f"d{k}": F.col(f"d{k}") / F.col(f"c{k}") for k in (1, 2, 3)}).drop("c1", "c2", "c3")


def l1_matrix(a: np.ndarray, b: np.ndarray | None = None, chunk: int = 256) -> np.ndarray:
    b = a if b is None else b
    return np.vstack([np.abs(a[i : i + chunk, None, :] - b[None]).sum(2) for i in range(0, len(a), chunk)]) if len(a) else np.zeros((0, len(b)))


def jaccard_matrix(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    b = a if b is None else b
    shared = a @ b.T
    united = a.sum(1)[:, None] + b.sum(1)[None] - shared
    return np.where(united > 0, 1 - shared / np.where(united > 0, united, 1), 0.0)


def cell_matrices(x: dict[str, np.ndarray], types: Types, constants: tuple[float, float, float], at: np.ndarray | None = None) -> list[np.ndarray]:
    """The three scaled distance matrices of one cell: from all rows, or those `at` some places, to all."""
    block = lambda cols: np.stack([x[c] for c in cols], 1).astype(float)
    some = lambda b: b if at is None else b[at]
    blocks = [block(c) for c in (types.performance, types.rates, types.labels)]
    raw = [l1_matrix(some(blocks[0]), blocks[0]), l1_matrix(some(blocks[1]), blocks[1]), jaccard_matrix(some(blocks[2]), blocks[2])]
    return [m / c if c else m for m, c in zip(raw, constants)]
