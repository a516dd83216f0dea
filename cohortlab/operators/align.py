"""Alignment of cluster labels over periods, and transitions of memberships."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import entropy, first_max, minus, norm2
from .distance import Types, combined_squared, pair_distances, scaled
from .panel import consecutive_pairs


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns z_<c>: pooled scores by the population standard deviation (one broadcast row)."""
    facts = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(facts))
    return out.withColumns({f"z_{c}": (F.col(c) - F.col(f"__m_{c}")) / F.nullif(f"__s_{c}", F.lit(0.0)) for c in columns}).drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def profiles(df: DataFrame, cell: list[str], u: str, k: int, columns: list[str]) -> DataFrame:
    """(cell, cluster, columns): membership-weighted means; clusters are numbered from 1."""
    long = df.select(*cell, *columns, F.posexplode(F.slice(u, 1, k)).alias("__c", "__u")).withColumn("cluster", F.col("__c") + 1)
    return long.groupBy(*cell, "cluster").agg(*[(F.sum(F.col("__u") * F.col(c)) / F.sum("__u")).alias(c) for c in columns])


def profile_costs(prof: DataFrame, group: list[str], period: str, columns: list[str]) -> DataFrame:
    """(group, period, a, b, cost): L1 distance of each cluster's profile at `period` to each one's at the next period."""
    now = prof.select(*group, period, F.col("cluster").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    then = prof.select(*group, (F.col(period) - 1).alias(period), F.col("cluster").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    cost = sum([F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns], F.lit(0.0))
    return now.join(then, [*group, period]).select(*group, period, "a", "b", cost.alias("cost"))


def medoid_costs(medoids: DataFrame, group: list[str], period: str, cluster: str, types: Types, weights: list[float], constants: DataFrame) -> DataFrame:
    """(group, period, a, b, cost): weighted squared distance of each cluster's medoid at `period` to each one's at the next period. constants: one row."""
    then = medoids.withColumn(period, F.col(period) - 1)
    d = scaled(pair_distances(medoids, then, [*group, period], cluster, types, ordered=False), constants)
    return d.select(*group, period, F.col("i").alias("a"), F.col("j").alias("b"), combined_squared(weights).alias("cost"))


def optimal_assignment(costs: DataFrame, group: list[str], k: int, digits: int = 9) -> DataFrame:
    """(group, a, b): the permutation of least total cost, the first in lexicographic order on ties (totals rounded to `digits`).

    For k up to 6 all k! permutations are a small table joined with the costs; for more the Hungarian method runs in one task a group, on its k * k costs (any optimum on ties).
    """
    if k > 6:

        def match(table: pa.Table) -> pa.Table:
            cost = np.full((k, k), np.nan)
            cost[table.column("a").to_numpy() - 1, table.column("b").to_numpy() - 1] = table.column("cost").to_numpy()
            if np.isnan(cost).any():  # a cluster is missing
                return pa.Table.from_arrays([*[table.column(c).slice(0, 0) for c in group], pa.array([], pa.int32()), pa.array([], pa.int32())], [*group, "a", "b"])
            n = pa.array(np.zeros(k, np.int64))
            return pa.Table.from_arrays([*[table.column(c).take(n) for c in group], pa.array(np.arange(1, k + 1), pa.int32()), pa.array(np.array(hungarian(cost)) + 1, pa.int32())], [*group, "a", "b"])

        kinds = dict(costs.dtypes)
        return costs.select(*group, "a", "b", "cost").groupBy(*group).applyInArrow(match, ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", a int, b int")
    spark = costs.sparkSession
    table = [(number, a + 1, b + 1) for number, p in enumerate(permutations(range(k))) for a, b in enumerate(p)]
    perms = spark.createDataFrame(table, "perm int, a int, b int")
    totals = costs.join(F.broadcast(perms), ["a", "b"]).groupBy(*group, "perm").agg(F.round(F.sum("cost"), digits).alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    best = totals.groupBy(*group).agg(F.min(F.struct("total", "perm"))["perm"].alias("perm"))
    return best.join(F.broadcast(perms), "perm").select(*group, "a", "b")


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in an assignment of least total cost, by shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, via, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[row_of[j] - 1, free - 1] - u[row_of[j]] - v[free]
            better = slack < least[free]
            least[free[better]], via[free[better]] = slack[better], j
            nxt = free[np.argmin(least[free])]
            step = least[nxt]
            u[row_of[used]] += step
            v[used] -= step
            least[free] -= step
            j = nxt
            if not row_of[j]:
                break
        while j:
            row_of[j], j = row_of[via[j]], via[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def propagate_labels(steps: DataFrame, group: list[str], period: str, first: int, last: int, k: int) -> DataFrame:
    """(group, period, cluster, label): labels of the first period carried on by the assignments (a -> b from a period to the next).

    Where a group lacks an assignment, labels start anew. One row a group holds its assignments, k numbers a period, and the labels are composed along them in one expression.
    """
    order = F.sort_array(F.collect_list(F.struct("b", "a")))  # k entries a period
    maps = steps.groupBy(*group, period).agg(F.transform(order, lambda x: x["a"].cast("int")).alias("__from"))  # by cluster of the next period: the one it comes from
    held = maps.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(period).cast("int"), "__from"))).alias("__maps"))
    fresh = F.sequence(F.lit(1), F.lit(k))

    def step(acc: Column, t: Column) -> Column:
        now = F.element_at(acc, -1)
        came = F.try_element_at(F.col("__maps"), t)
        then = F.when(came.isNull(), fresh).otherwise(F.transform(came, lambda a: F.element_at(now, a)))
        return F.array_append(acc, then)

    every = F.aggregate(F.sequence(F.lit(first), F.lit(last - 1)), F.array(fresh), step) if last > first else F.array(fresh)
    rows = held.select(*group, F.posexplode(every).alias("__at", "__labels")).select(*group, (F.col("__at") + first).cast(steps.schema[period].dataType).alias(period), F.posexplode("__labels").alias("__c", "label"))
    return rows.select(*group, period, (F.col("__c") + 1).alias("cluster"), "label")


def identity_matches(costs: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group, consistent): is the optimal match of labels at a period with those at the next the identity?"""
    return optimal_assignment(costs, group, k).groupBy(*group).agg(F.min((F.col("a") == F.col("b")).cast("int")).cast("boolean").alias("consistent"))


def medoid_agreement(medoids: DataFrame, group: list[str], label: str, attribute: str) -> DataFrame:
    """(group, agreement): mean over labels of the share of periods in which a label's medoid has its modal attribute."""
    counted = medoids.groupBy(*group, label, attribute).agg(F.count(F.lit(1)).alias("n"))
    modal = counted.groupBy(*group, label).agg((F.max("n") / F.sum("n")).alias("share"))
    return modal.groupBy(*group).agg(F.avg("share").alias("agreement")) if group else modal.agg(F.avg("share").alias("agreement"))


def match_ambiguity(costs: DataFrame, chosen: DataFrame, group: list[str], limit: float = 1.10) -> DataFrame:
    """Per group: mean and largest chosen cost, least ratio of the next best in the row or column to the chosen, and how many are below the limit."""
    on = [*group, "a", "b"]
    marked = costs.join(chosen.withColumn("__c", F.lit(True)), on, "left")
    other = F.when(F.col("__c").isNull(), F.col("cost"))
    row, col = Window.partitionBy(*group, "a"), Window.partitionBy(*group, "b")
    near = marked.withColumn("alt", F.least(F.min(other).over(row), F.min(other).over(col))).where("__c")
    r = F.col("alt") / F.nullif("cost", F.lit(0.0))
    return near.groupBy(*group).agg(F.avg("cost").alias("mean_d"), F.max("cost").alias("max_d"), F.min(r).alias("min_ratio"), F.sum(F.when(r < limit, 1).otherwise(0)).cast("long").alias("n_ambiguous"))


def relabel(members: DataFrame, labels: DataFrame, cell: list[str], u: str, k: int) -> DataFrame:
    """Memberships put in the order of the labels; noise stays last."""
    order = labels.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("label", "cluster"))).alias("__o"))  # k entries a cell
    moved = F.concat(F.transform("__o", lambda x: F.element_at(u, x["cluster"])), F.slice(u, k + 1, 1))
    out = members.join(order, cell).withColumn(u, moved).drop("__o")
    return out.withColumn("hard", first_max(F.col(u)))


def transitions(members: DataFrame, entity: str | list[str], period: str, u: str, k: int | None = None) -> DataFrame:
    """One row for each consecutive pair: membership changes, their norm over the k clusters (all but the last membership, if None), the cluster that moved most, entropies, hard labels."""
    pairs = consecutive_pairs(members, entity, period, [u, "hard"])
    delta = minus(F.col(f"{u}_t1"), F.col(f"{u}_t"))
    own = F.slice(delta, F.lit(1), F.size(delta) - 1 if k is None else F.lit(k))
    h0, h1 = entropy(F.col(f"{u}_t")), entropy(F.col(f"{u}_t1"))
    return pairs.withColumns({"delta": delta, "transition_norm": norm2(own), "dominant": first_max(F.transform(own, F.abs)), "entropy_t": h0, "entropy_t1": h1, "delta_entropy": h1 - h0})


def persistence(pairs: DataFrame, k: int) -> DataFrame:
    """Share of pairs with one label, among those that are noise in neither period."""
    return pairs.where((F.col("hard_t") <= k) & (F.col("hard_t1") <= k)).agg(F.avg((F.col("hard_t") == F.col("hard_t1")).cast("double")).alias("persistence"), F.count(F.lit(1)).alias("pairs"))


def transition_matrix(pairs: DataFrame, k: int) -> DataFrame:
    """(hard_t, hard_t1, pairs, share of the row) over the full domain, zeros included."""
    spark = pairs.sparkSession
    domain = spark.range(1, k + 2).select(F.col("id").cast("int").alias("hard_t"), F.explode(F.sequence(F.lit(1), F.lit(k + 1))).alias("hard_t1"))
    counted = pairs.groupBy("hard_t", "hard_t1").agg(F.count(F.lit(1)).alias("pairs"))
    full = F.broadcast(domain).join(counted, ["hard_t", "hard_t1"], "left").na.fill(0, ["pairs"])
    return full.withColumn("share", F.col("pairs") / F.nullif(F.sum("pairs").over(Window.partitionBy("hard_t")), F.lit(0)))


def name_by_profile(prof: DataFrame, features: list[tuple[str, str]], rest: str) -> dict[int, str]:
    """Names for k clusters: for each (feature, name) in turn the unnamed cluster with the largest value, the least number on ties. k rows reach the driver."""
    rows = {r["cluster"]: r for r in prof.collect()}
    out: dict[int, str] = {}
    for feature, name in features:
        if left := sorted(set(rows) - set(out)):
            out[max(left, key=lambda c: (rows[c][feature], -c))] = name
    return out | {c: rest for c in set(rows) - set(out)}


def anchor(prof: DataFrame, fixed: DataFrame, group: list[str], columns: list[str], k: int) -> DataFrame:
    """(group, a, b): assignment of each group's clusters (a) to those of a fixed solution's profiles (b) by least total L1 distance."""
    other = fixed.select(F.col("cluster").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    cost = sum([F.abs(F.col(c) - F.col(f"b_{c}")) for c in columns], F.lit(0.0))
    costs = prof.crossJoin(F.broadcast(other)).select(*group, F.col("cluster").alias("a"), "b", cost.alias("cost"))  # k rows of `fixed`
    return optimal_assignment(costs, group, k)


def anchor_by(prof: DataFrame, fixed: DataFrame, group: list[str], cell: list[str], columns: list[str], k: int) -> DataFrame:
    """(group, a, b): assignment of each group's clusters to those of the fixed solution of its own cell."""
    other = fixed.select(*cell, F.col("cluster").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    cost = sum([F.abs(F.col(c) - F.col(f"b_{c}")) for c in columns], F.lit(0.0))
    costs = prof.join(other, cell).select(*group, F.col("cluster").alias("a"), "b", cost.alias("cost"))  # k rows a cell
    return optimal_assignment(costs, group, k)


def array_columns(u: Column, k: int, prefix: str) -> list[Column]:
    return [F.element_at(u, j + 1).alias(f"{prefix}{j + 1}") for j in range(k)]
