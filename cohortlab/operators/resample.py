"""Two-stage cluster bootstrap, its summary, and resumable grids of configurations."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_tail, normal_two_sided


def number_entities(entities: DataFrame, entity: str, bucket_rows: int = 100_000) -> tuple[DataFrame, int]:
    """(entity, __number) of distinct entities, 0 .. n - 1, and n. Numbers run within hash buckets, and the buckets' counts before; a count a bucket reaches the driver."""
    n = entities.count()
    buckets = max(1, -(-n // bucket_rows))
    dealt = entities.select(F.col(entity), F.pmod(F.xxhash64(F.col(entity).cast("string")), F.lit(buckets)).cast("int").alias("__bucket"))
    base, at = [], 0
    for b, c in sorted(map(tuple, dealt.groupBy("__bucket").count().collect())):
        base.append((b, at))
        at += c
    starts = entities.sparkSession.createDataFrame(base, "__bucket int, __base long")
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(entity))
    return dealt.join(F.broadcast(starts), "__bucket").select(entity, (F.col("__base") + own - 1).alias("__number")), n


def resample_entities(df: DataFrame, entity: str, replicates: range, seed: int = 0) -> DataFrame:
    """df for each replicate with as many entities as there are, drawn with replacement: (replicate, copy, draw id `entity#copy`).

    Draw j of a replicate takes the entity whose number is a hash of (j, replicate), so draws need no gathering and every replicate has exactly as many as entities.
    An entity with no draw is left out.
    """
    numbered, n = number_entities(df.select(entity).distinct(), entity)
    draws = numbered.select("__number").withColumn("replicate", F.explode(F.array(*[F.lit(i) for i in replicates])))
    taken = draws.select("replicate", F.pmod(F.xxhash64("__number", "replicate", F.lit(seed)), F.lit(max(1, n))).alias("__number")).groupBy("replicate", "__number").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    copies = taken.join(numbered, "__number").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n", "__number")
    return df.join(copies, entity).withColumn("draw_id", F.concat_ws("#", F.col(entity).cast("string"), "copy"))


def summarize_draws(draws: DataFrame, estimates: dict[str, tuple[float, float]]) -> DataFrame:
    """(term, coef, naive_se, boot_se, se_ratio, p_boot, ci_low, ci_high, boot_bias) from draws (one column a term) and (coef, se) of the sample. Normal intervals."""
    terms = list(estimates)
    row = draws.agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in terms], *[F.avg(c).alias(f"m_{c}") for c in terms]).first()
    out = []
    for c in terms:
        coef, se = estimates[c]
        boot = row[f"s_{c}"]
        out.append((c, coef, se, boot, boot / se, normal_two_sided(coef / boot), coef - 1.96 * boot, coef + 1.96 * boot, row[f"m_{c}"] - coef))
    return draws.sparkSession.createDataFrame(out, "term string, coef double, naive_se double, boot_se double, se_ratio double, p_boot double, ci_low double, ci_high double, boot_bias double")


def wald_from_draws(draws: DataFrame, estimates: dict[str, float]) -> float:
    """Chi-squared p-value of all terms together, with the covariance of the draws."""
    terms = list(estimates)
    row = draws.agg(*[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)]).first()
    v = np.array([[row[f"c{i}_{j}"] for j in range(len(terms))] for i in range(len(terms))])
    b = np.array(list(estimates.values()))
    return chi2_tail(float(b @ np.linalg.pinv(v) @ b), len(terms))


def fingerprint(settings: dict) -> str:
    """Key of a configuration and its inputs: results are reused only under the same one."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def grid(axes: dict[str, list]) -> list[dict]:
    """All combinations of the axes, the last one varying fastest, each with its fingerprint."""
    out: list[dict] = [{}]
    for name, values in axes.items():
        out = [x | {name: v} for x in out for v in values]
    return [x | {"fingerprint": fingerprint(x)} for x in out]
