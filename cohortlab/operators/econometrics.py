"""Panel econometrics from one-pass Gram aggregates: OLS with clustered errors, Wald tests, grouped cross-validation, fixed and random effects, PCA.

Spark adds up cross products; only k-by-k matrices reach the driver, where numpy solves them. Columns are centred at pooled means first, which keeps
the cross products well conditioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_tail, f_tail, normal_two_sided


def _products(columns: list[str]) -> list[Column]:
    return [(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]


def gram(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, n, m_i.., p_i..): sums of the columns and of their products, upper triangle by rows. Partial sums before any shuffle."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.sum(p).alias(f"p{i}") for i, p in enumerate(_products(columns))]]
    return df.groupBy(*by).agg(*sums) if by else df.agg(*sums)


def _unpack(row, k: int) -> tuple[float, np.ndarray, np.ndarray]:  # noqa: ANN001
    full, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            full[i, j] = full[j, i] = row[f"p{at}"] or 0.0
            at += 1
    return float(row["n"]), np.array([row[f"m{i}"] or 0.0 for i in range(k)]), full


def centred(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """df with the columns less their pooled means, and the means."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    means = {c: row[c] or 0.0 for c in columns}
    return df.withColumns({c: F.col(c) - F.lit(means[c]) for c in columns}), means


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of least norm, from cross products scaled to a unit diagonal."""
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    return np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-12) @ (xy / scale) / scale


@dataclass
class Regression:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    groups: int
    r2: float
    adj_r2: float

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    @property
    def p(self) -> list[float]:
        """Two-sided normal p-values."""
        return [normal_two_sided(b / s) if s > 0 else float("nan") for b, s in zip(self.coef, self.se)]

    def wald_statistic(self, block: list[str]) -> tuple[float, int, int]:
        """(F statistic, its degrees of freedom, those of the denominator) of a block."""
        at = [self.names.index(c) for c in block]
        b, v = self.coef[at], self.cov[np.ix_(at, at)]
        return float(b @ np.linalg.pinv(v) @ b) / len(at), len(at), self.groups - 1

    def wald(self, block: list[str], f_form: bool = True) -> float:
        """p-value that the block's coefficients are all 0: the F law with groups - 1 denominator degrees, or chi-squared."""
        f, df, den = self.wald_statistic(block)
        return f_tail(f, df, den) if f_form else chi2_tail(f * df, df)


def _meat(data: DataFrame, names: list[str], cluster: str, beta: np.ndarray, y: str) -> tuple[int, np.ndarray]:
    """(clusters, sum of the outer products of their scores), by aggregates."""
    k = len(names)
    residual = F.col(y) - sum([F.lit(float(b)) * F.col(c) for b, c in zip(beta, names)], F.lit(0.0))
    scores = data.groupBy(cluster).agg(*[F.sum(F.col(c) * residual).alias(f"s{i}") for i, c in enumerate(names)])
    row = scores.agg(F.count(F.lit(1)).alias("g"), *[F.sum(p).alias(f"p{i}") for i, p in enumerate(_products([f"s{i}" for i in range(k)]))]).first()
    groups, meat, at = int(row["g"]), np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = row[f"p{at}"] or 0.0
            at += 1
    return groups, meat


def _meat_of(data: DataFrame, columns: list[str], cluster: str, at: list[int], beta: np.ndarray, y: str) -> tuple[int, np.ndarray]:
    """The same of many columns, by matrix products; at: their places after the constant."""
    last = [c for c in columns if c != y]
    places = [0 if i == 0 else last.index(columns[i - 1]) + 1 for i in at]
    found = cluster_meats(data.withColumn("__key", F.lit("all")), "__key", [*last, y], cluster, {"all": {"fit": (places, beta)}})
    return found.get(("all", "fit"), (0, np.zeros((len(at), len(at)))))


#: Up to so many columns cross products are aggregates; of more they are matrix products in Python workers, since the aggregates' number is its square.
FEW = 8


def ols_clustered(df: DataFrame, y: str, x: list[str], cluster: str, constant: bool = True, extra_df: int = 0) -> Regression:
    """OLS of y on x (and a constant) with cluster-robust covariance and its small-sample factor G/(G-1) (n-1)/(n-k).

    Two passes: cross products, then for each cluster its summed scores, whose outer products are summed before they reach the driver.
    """
    data = df.select(cluster, *dict.fromkeys([y, *x])).na.drop()
    data, means = centred(data, list(dict.fromkeys([y, *x]))) if constant else (data, {c: 0.0 for c in [y, *x]})
    names = ["const", *x] if constant else list(x)
    data = data.withColumn("const", F.lit(1.0)) if constant else data
    k, many = len(names), len(names) > FEW
    if many:
        own = list(dict.fromkeys([*x, y]))
        at = [0 if c == "const" and constant else own.index(c) + 1 for c in [*names, y]]
        data = data.drop("const") if constant else data
        first = fold_grams(data.withColumn("__key", F.lit("all")), "__key", own, cluster, 1, 1).first()
        g = np.zeros((len(own) + 1,) * 2) if first is None else np.array(first["g"]).reshape(len(own) + 1, -1)
        n, full = float(g[0, 0]), g[np.ix_(at, at)]
    else:
        n, _, full = _unpack(gram(data, [*names, y]).first(), k + 1)
    xx, xy, yy = full[:k, :k], full[:k, k], full[k, k]
    beta = solve(xx, xy)
    groups, meat = _meat_of(data, own, cluster, at[:k], beta, y) if many else _meat(data, names, cluster, beta, y)
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    bread = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-12) / np.outer(scale, scale)
    cov = bread @ meat @ bread * groups / max(1, groups - 1) * (n - 1) / max(1.0, n - k - extra_df)
    if constant:  # the constant at the columns' own zero
        turn = np.eye(k)
        turn[0, 1:] = [-means[c] for c in x]
        beta = turn @ beta
        beta[0] += means[y]
        cov = turn @ cov @ turn.T
    sse = yy - xy @ solve(xx, xy)
    r2 = 1 - sse / yy if yy else float("nan")
    return Regression(names, beta, cov, int(n), groups, float(r2), float(1 - (1 - r2) * (n - constant) / max(1.0, n - k)))


def compare(df: DataFrame, y: str, base: list[str], added: list[str], cluster: str) -> dict[str, float]:
    """Nested models: adjusted R2 of both, its gain, and the Wald p-value of what is added."""
    small, large = ols_clustered(df, y, base, cluster), ols_clustered(df, y, [*base, *added], cluster)
    return {"n": large.n, "k_added": len(added), "adjR2_base": small.adj_r2, "adjR2_ext": large.adj_r2, "d_adjR2": large.adj_r2 - small.adj_r2, "wald_p": large.wald(added)}


def fold_of(entity: Column, rep: Column | int, folds: int, seed: int = 0) -> Column:
    """Fold of an entity in a repetition, from a hash: no fold splits an entity."""
    r = F.lit(rep) if isinstance(rep, int) else rep
    return F.pmod(F.xxhash64(entity.cast("string"), r, F.lit(seed)), F.lit(folds)).cast("int")


def grouped_cv(df: DataFrame, y: str, models: dict[str, list[str]], entity: str, reps: int = 30, folds: int = 5, seed: int = 0, fold: Callable[[Column, Column, int], Column] | None = None) -> dict[str, list[float]]:
    """Out-of-sample R2 of each model in each repetition, all models on the same folds; the total sum of squares is about the training mean.

    fold: of (entity, repetition, folds), by default a hash. One pass gives the cross products of each (repetition, fold); a training set's are the total less its fold's. reps * folds rows reach the driver.
    """
    columns = list(dict.fromkeys([c for x in models.values() for c in x]))
    data, _ = centred(df.select(entity, *dict.fromkeys([y, *columns])).na.drop(), list(dict.fromkeys([y, *columns])))
    names = ["one", *columns, y]
    parts: dict[int, dict[int, np.ndarray]] = {}
    for row in fold_grams(data.withColumn("__key", F.lit("all")), "__key", [*columns, y], entity, reps, folds, seed, fold).collect():
        parts.setdefault(row["rep"], {})[row["fold"]] = np.array(row["g"]).reshape(len(names), len(names))
    out: dict[str, list[float]] = {m: [] for m in models}
    for rep in sorted(parts):
        own, total = parts[rep], sum(parts[rep].values())
        sst, sse = 0.0, dict.fromkeys(models, 0.0)
        for test in own.values():
            train, last = total - test, len(names) - 1
            if train[0, 0] <= 0:
                continue
            mean = train[0, last] / train[0, 0]
            sst += test[last, last] - 2 * mean * test[0, last] + mean**2 * test[0, 0]
            for m, x in models.items():
                at = [0, *[names.index(c) for c in x]]
                b = solve(train[np.ix_(at, at)], train[at, last])
                sse[m] += test[last, last] - 2 * b @ test[at, last] + b @ test[np.ix_(at, at)] @ b
        for m in models:
            out[m].append(float(1 - sse[m] / sst) if sst else float("nan"))
    return out


def within(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Columns less their entity means. The means are an aggregate joined back."""
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"__{c}") for c in columns], F.count(F.lit(1)).alias("__size"))
    return df.join(means, entity).withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns})


def fixed_effects(df: DataFrame, y: str, x: list[str], entity: str, clustered: bool = False) -> tuple[list[str], Regression]:
    """Entity effects by demeaning; columns that the effects absorb are dropped. Unadjusted or clustered covariance, with entities taken off the degrees of freedom."""
    data = df.select(entity, y, *x).na.drop()
    d = within(data, entity, [y, *x])
    spread = d.agg(*[F.stddev_samp(c).alias(c) for c in x]).first()
    kept = [c for c in x if (spread[c] or 0) > 1e-8]
    n, _, full = _unpack(gram(d, [*kept, y]).first(), len(kept) + 1)
    rank: list[str] = []  # those that the ones before don't span
    for i, c in enumerate(kept):
        at = [kept.index(r) for r in rank] + [i]
        s = np.sqrt(np.diag(full)[at])
        if np.linalg.svd(full[np.ix_(at, at)] / np.outer(s, s), compute_uv=False)[-1] > 1e-9:
            rank.append(c)
    entities = d.select(entity).distinct().count()
    fit = ols_clustered(d, y, rank, entity, constant=False, extra_df=0 if clustered else entities)
    if not clustered:
        at = [kept.index(c) for c in rank]
        xx, xy = full[np.ix_(at, at)], full[at, len(kept)]
        b = solve(xx, xy)
        s2 = (full[-1, -1] - b @ xy) / max(1.0, n - entities - len(rank))
        fit.cov = np.linalg.pinv(xx) * s2
    return rank, fit


def random_effects(df: DataFrame, y: str, x: list[str], entity: str) -> tuple[Regression, float]:
    """Quasi-demeaned GLS with Swamy-Arora variance components; also the mean share theta that is taken off. Unadjusted covariance."""
    data = df.select(entity, y, *x).na.drop()
    _, fe = fixed_effects(data, y, x, entity)
    d = within(data, entity, [y, *x])
    n, entities = data.count(), fe.groups
    _, _, full = _unpack(gram(d, [*fe.names, y]).first(), len(fe.names) + 1)
    s_e = (full[-1, -1] - fe.coef @ full[:-1, -1]) / max(1.0, n - entities - len(fe.names))
    means = data.groupBy(entity).agg(*[F.avg(c).alias(c) for c in (y, *x)], F.count(F.lit(1)).alias("t"))
    between = ols_clustered(means, y, x, entity)
    residual = F.col(y) - sum([F.lit(float(b)) * (F.lit(1.0) if c == "const" else F.col(c)) for b, c in zip(between.coef, between.names)], F.lit(0.0))
    row = means.agg(F.sum(residual * residual).alias("s"), F.sum(1 / F.col("t")).alias("h")).first()
    s_u = max(0.0, row["s"] / max(1.0, entities - len(x) - 1) - s_e * row["h"] / entities)
    sized = data.join(means.select(entity, "t", *[F.col(c).alias(f"__{c}") for c in (y, *x)]), entity)
    theta = 1 - F.sqrt(F.lit(s_e) / (F.lit(s_e) + F.col("t") * F.lit(s_u)))
    turned = sized.withColumn("__theta", theta).withColumns({c: F.col(c) - F.col("__theta") * F.col(f"__{c}") for c in (y, *x)}).withColumn("__one", 1 - F.col("__theta"))
    fit = ols_clustered(turned, y, ["__one", *x], entity, constant=False)
    _, _, g = _unpack(gram(turned, ["__one", *x, y]).first(), len(x) + 2)
    sse = g[-1, -1] - fit.coef @ g[:-1, -1]
    fit.cov = np.linalg.pinv(g[:-1, :-1]) * sse / max(1.0, n - len(x) - 1)
    return fit, float(turned.agg(F.avg("__theta")).first()[0])


def hausman(fe: Regression, re: Regression) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p-value) that both estimators agree. It rests on unadjusted covariances, so take it as a hint only."""
    names = [c for c in fe.names if c in re.names]
    pick = lambda r: (r.coef[[r.names.index(c) for c in names]], r.cov[np.ix_(*[[r.names.index(c) for c in names]] * 2)])
    (b1, v1), (b2, v2) = pick(fe), pick(re)
    v = v1 - v2
    stat, df = max(0.0, float((b1 - b2) @ np.linalg.pinv(v) @ (b1 - b2))), int(np.linalg.matrix_rank(v))
    return stat, df, chi2_tail(stat, df) if df else 1.0


def pca(df: DataFrame, columns: list[str], share: float = 0.70) -> tuple[np.ndarray, np.ndarray, int]:
    """(loadings, shares of variance, components for `share` of it) of pooled z-scores, from their correlation matrix; each vector's largest loading is positive."""
    data, _ = centred(df.select(*columns).na.drop(), columns)
    _, _, full = _unpack(gram(data, columns).first(), len(columns))
    s = np.sqrt(np.diag(full))
    values, vectors = np.linalg.eigh(full / np.outer(s, s))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(columns))])
    part = values / values.sum()
    return vectors, part, int(np.searchsorted(np.cumsum(part), share) + 1)


def reference_cluster(df: DataFrame, columns: list[str]) -> str:
    """The membership column of the largest mean, the first on ties. One row reaches the driver."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return max(columns, key=lambda c: (row[c], -columns.index(c)))


# -- many regressions at once --------------------------------------------------------------------------------------------------------


def _arrays(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """A column of ones, and the columns."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    return np.column_stack([np.ones(len(batch)), *[batch.column(at[c]).to_numpy(zero_copy_only=False).astype(float) for c in columns]])


def _row(schema: pa.Schema, values: list, g: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(values, schema)], pa.array([g], pa.list_(pa.float64()))], schema=schema)


def add_up(parts: DataFrame, keys: list[str], groups: int = 64) -> DataFrame:
    """(keys, task, g): arrays g of the tasks' sums added up by key, first within groups of tasks."""
    schema = parts.select(*keys, "task", "g").schema

    def add(table: pa.Table) -> pa.Table:
        g = table.column("g").combine_chunks()
        total = g.flatten().to_numpy().reshape(len(g), -1).sum(0)
        return pa.Table.from_arrays([*[table.column(k).slice(0, 1) for k in (*keys, "task")], pa.array([total], pa.list_(pa.float64()))], [*keys, "task", "g"])

    once = parts.select(*keys, F.pmod("task", F.lit(groups)).alias("task"), "g").groupBy(*keys, "task").applyInArrow(add, schema)
    return once.groupBy(*keys).applyInArrow(add, schema)


def fold_grams(df: DataFrame, key: str, columns: list[str], entity: str, reps: int, folds: int, seed: int = 0, dealt: Callable[[Column, Column, int], Column] | None = None) -> DataFrame:
    """(key, rep, fold, g): cross products of the constant and the columns in each fold of each repetition, added up in every task first. reps: at least 1; no fold splits an entity."""
    fold = F.array(*[fold_of(F.col(entity), r, folds, seed) if dealt is None else dealt(F.col(entity), F.lit(r), folds) for r in range(reps)])
    data = df.select(F.col(key).cast("string").alias("key"), *columns, fold.alias("__folds"), F.spark_partition_id().alias("__task"))
    schema = pa.schema([("key", pa.string()), ("rep", pa.int32()), ("fold", pa.int32()), ("task", pa.int32()), ("g", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        task = 0
        for batch in batches:
            if not len(batch):
                continue
            x, at = _arrays(batch, columns), {n: i for i, n in enumerate(batch.schema.names)}
            task = batch.column(at["__task"])[0].as_py()
            code = batch.column(at["key"]).dictionary_encode()
            own, names = code.indices.to_numpy(), code.dictionary.to_pylist()
            dealt = batch.column(at["__folds"]).flatten().to_numpy().reshape(len(batch), reps)
            for r in range(reps):
                place = own.astype(np.int64) * folds + dealt[:, r]
                order = np.argsort(place, kind="stable")
                bounds = np.flatnonzero(np.diff(place[order], prepend=-1))
                for i, j in zip(bounds, np.append(bounds[1:], len(order))):
                    rows = x[order[i:j]]
                    k, f = divmod(int(place[order[i]]), folds)
                    g = rows.T @ rows
                    sums[names[k], r, f] = sums[names[k], r, f] + g if (names[k], r, f) in sums else g
        for (k, r, f), g in sums.items():
            yield _row(schema, [k, r, f, task], g.ravel())

    return add_up(data.mapInArrow(run, "key string, rep int, fold int, task int, g array<double>"), ["key", "rep", "fold"]).drop("task")


def from_gram(g: np.ndarray, at: list[int]) -> dict:
    """OLS of the last column on the columns `at` (0 is the constant) from cross products: coefficients, cross products, sums of squares, R2."""
    xx, xy = g[np.ix_(at, at)], g[at, -1]
    beta, n = solve(xx, xy), g[0, 0]
    sst = g[-1, -1] - g[0, -1] ** 2 / n if n else 0.0
    sse = max(0.0, g[-1, -1] - 2 * beta @ xy + beta @ xx @ beta)
    r2 = 1 - sse / sst if sst > 0 else float("nan")
    return {"at": at, "beta": beta, "xx": xx, "n": float(n), "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / max(1.0, n - len(at))}


def varying(g: np.ndarray, at: list[int], least: float = 1e-10) -> list[int]:
    """Those columns, in order and once each, whose standard deviation is above `least`."""
    n = g[0, 0]
    spread = lambda i: np.sqrt(max(0.0, g[i, i] - g[0, i] ** 2 / n) / max(1.0, n - 1)) if n else 0.0
    return [i for i in dict.fromkeys(at) if spread(i) > least]


def out_of_sample(grams: dict[tuple[int, int], np.ndarray], models: list[list[int]]) -> list[list[float]]:
    """Out-of-sample R2 of each model (columns with the constant) in each repetition, from the cross products of its folds."""
    out: list[list[float]] = [[] for _ in models]
    for rep in sorted({r for r, _ in grams}):
        own = [g for (r, _), g in grams.items() if r == rep]
        total, sst, sse = sum(own), 0.0, [0.0] * len(models)
        for test in own:
            train = total - test
            if train[0, 0] <= 0.5:
                continue
            mean = train[0, -1] / train[0, 0]
            sst += test[-1, -1] - 2 * mean * test[0, -1] + mean**2 * test[0, 0]
            for m, at in enumerate(models):
                b = solve(train[np.ix_(at, at)], train[at, -1])
                sse[m] += test[-1, -1] - 2 * b @ test[at, -1] + b @ test[np.ix_(at, at)] @ b
        for m in range(len(models)):
            out[m].append(1 - sse[m] / sst if sst > 0 else float("nan"))
    return out


def cluster_meats(df: DataFrame, key: str, columns: list[str], entity: str, fits: dict[str, dict[str, tuple[list[int], np.ndarray]]]) -> dict[tuple[str, str], tuple[int, np.ndarray]]:
    """{(key, model): (clusters, sum over entities of the outer products of their scores)}, for models {key: {model: (columns, coefficients)}}; the outcome is the last column.

    Rows of an entity meet in one task by a shuffle on it, sorted by key, so a task holds the scores of one entity at a time. One row a model and group of tasks is added up further.
    """
    data = df.select(F.col(key).cast("string").alias("key"), F.col(entity).alias("__entity"), *columns).repartition(F.col("__entity")).sortWithinPartitions("key", "__entity")
    data = data.withColumn("__task", F.spark_partition_id())
    schema = pa.schema([("key", pa.string()), ("model", pa.string()), ("task", pa.int32()), ("g", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        held: tuple | None = None  # key, entity and scores of the entity that the last batch ended with
        task = 0

        def put(k: str, name: str, scores: np.ndarray) -> None:
            g = np.append(float(len(scores)), (scores.T @ scores).ravel())
            sums[k, name] = sums[k, name] + g if (k, name) in sums else g

        for batch in batches:
            if not len(batch):
                continue
            x, at = _arrays(batch, columns), {n: i for i, n in enumerate(batch.schema.names)}
            task = batch.column(at["__task"])[0].as_py()
            code = batch.column(at["key"]).dictionary_encode()
            own, names = code.indices.to_numpy(), code.dictionary.to_pylist()
            who = batch.column(at["__entity"]).dictionary_encode()
            who, people = who.indices.to_numpy(), who.dictionary.to_pylist()
            bounds = np.flatnonzero(np.diff(own, prepend=-1))
            for i, j in zip(bounds, np.append(bounds[1:], len(own))):
                k, heads = names[own[i]], np.flatnonzero(np.diff(who[i:j], prepend=-1))
                scores = {name: np.add.reduceat(x[i:j][:, c] * (x[i:j, -1] - x[i:j][:, c] @ b)[:, None], heads) for name, (c, b) in fits.get(k, {}).items()}
                if held and (held[0], held[1]) == (k, people[who[i]]):
                    for name in scores:
                        scores[name][0] += held[2][name]
                elif held:
                    for name, v in held[2].items():
                        put(held[0], name, v[None])
                for name, v in scores.items():
                    if len(v) > 1:
                        put(k, name, v[:-1])
                held = k, people[who[j - 1]], {name: v[-1] for name, v in scores.items()}
        if held:
            for name, v in held[2].items():
                put(held[0], name, v[None])
        for (k, name), g in sums.items():
            yield _row(schema, [k, name, task], g)

    found = add_up(data.mapInArrow(run, "key string, model string, task int, g array<double>"), ["key", "model"])
    out = {}
    for r in found.collect():  # one row a model
        g = np.array(r["g"])
        size = int(round((len(g) - 1) ** 0.5))
        out[r["key"], r["model"]] = (int(round(g[0])), g[1:].reshape(size, size))
    return out


def sandwich(fit: dict, clusters: int, meat: np.ndarray) -> np.ndarray:
    """Cluster-robust covariance with its small-sample factor G/(G-1) (n-1)/(n-k)."""
    xx, n, k = fit["xx"], fit["n"], len(fit["at"])
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    bread = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-12) / np.outer(scale, scale)
    return bread @ meat @ bread * clusters / max(1, clusters - 1) * (n - 1) / max(1.0, n - k)


@dataclass
class Nested:
    """Two nested models of one key: what `added` (names of columns) adds to a baseline."""

    key: str
    model: str
    n: int
    entities: int
    added: list[str]
    adj_r2_base: float
    adj_r2_ext: float
    wald_p: float
    coef: np.ndarray
    se: np.ndarray
    oos_base: float
    oos_ext: float
    share_better: float


def nested_models(df: DataFrame, key: str, columns: list[str], y: str, entity: str, specs: Callable[[str, np.ndarray, list[str]], dict[str, tuple[list[str], list[str]]]], reps: int = 10, folds: int = 5) -> list[Nested]:
    """All pairs of nested models of all keys, from two passes over df.

    specs(key, total cross products, names of columns) gives {model: (baseline columns, added columns)}; constant columns fall away. The cross products of all folds are solved key by key
    on the executors; the totals and the clusters' meats, one row a key or model, reach the driver. reps = 0 leaves out cross-validation.
    """
    names = list(dict.fromkeys(columns))
    data, means = centred(df.select(key, entity, *names, y).na.drop(), [*names, y])
    every = ["const", *names]

    def chosen(k: str, g: np.ndarray) -> dict[str, tuple[list[int], list[int], list[str]]]:
        shifted = g.copy()  # the means put back, for what specs wants to know
        shift = np.array([0.0, *[means[c] for c in (*names, y)]])
        shifted[0, 1:] += shift[1:] * g[0, 0]
        out = {}
        for model, (base, added) in specs(k, shifted, every).items():
            kept = varying(g, [every.index(c) for c in (*base, *added)])
            first = [0, *[i for i in kept if every[i] in base]]
            more = [i for i in kept if i not in first]
            out[model] = (first, [*first, *more], [every[i] for i in more])
        return out

    def solve_key(table: pa.Table) -> pa.Table:
        k = table.column("key")[0].as_py()
        size = len(every) + 1
        grams = {(r, f): np.array(g).reshape(size, size) for r, f, g in zip(table.column("rep").to_pylist(), table.column("fold").to_pylist(), table.column("g").to_pylist())}
        total = sum(g for (r, _), g in grams.items() if r == 0)
        models, values = chosen(k, total), {}
        if reps:
            flat = [at for first, both, _ in models.values() for at in (first, both)]
            values = dict(zip(((m, s) for m in models for s in (0, 1)), out_of_sample(grams, flat)))
        rows = [(k, m, values.get((m, 0), [float("nan")]), values.get((m, 1), [float("nan")])) for m in models]
        return pa.Table.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows], pa.list_(pa.float64())), pa.array([x[3] for x in rows], pa.list_(pa.float64())), pa.array([total.ravel()] * len(rows), pa.list_(pa.float64()))], ["key", "model", "base", "ext", "g"])

    grams = fold_grams(data, key, [*names, y], entity, max(1, reps), folds)
    solved = grams.groupBy("key").applyInArrow(solve_key, "key string, model string, base array<double>, ext array<double>, g array<double>").collect()
    size, fits, facts = len(every) + 1, {}, []
    for r in solved:
        total = np.array(r["g"]).reshape(size, size)
        first, both, added = chosen(r["key"], total)[r["model"]]
        small, large = from_gram(total, first), from_gram(total, both)
        fits.setdefault(r["key"], {})[r["model"]] = (both, large["beta"])
        facts.append((r, small, large, added))
    meats = cluster_meats(data, key, [*names, y], entity, fits) if fits else {}
    out = []
    for r, small, large, added in sorted(facts, key=lambda x: (x[0]["key"], x[0]["model"])):
        clusters, meat = meats[r["key"], r["model"]]
        cov, q = sandwich(large, clusters, meat), len(added)
        b, v = large["beta"][len(large["at"]) - q :], cov[len(large["at"]) - q :, len(large["at"]) - q :]
        p = f_tail(float(b @ np.linalg.pinv(v) @ b) / q, q, clusters - 1) if q and clusters > 1 else float("nan")
        base, ext = np.array(r["base"]), np.array(r["ext"])
        out.append(Nested(r["key"], r["model"], int(round(large["n"])), clusters, added, float(small["adj_r2"]), float(large["adj_r2"]), p, b, np.sqrt(np.maximum(np.diag(v), 0)), float(base.mean()), float(ext.mean()), float((ext > base).mean())))
    return out
