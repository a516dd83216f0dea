"""Panel construction: merging sources, exposure rates, shrinkage, robust scaling, features, filters and leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def number(text: Column | str) -> Column:
    """Number in a text, null where there is none; NaN counts as null."""
    x = (F.col(text) if isinstance(text, str) else text).try_cast("double")
    return F.when(~F.isnan(x), x)


def season_code(x: Column) -> Column:
    """Text of at least four digits, padded by zeros on the left; longer ones stay."""
    s = x.cast("string")
    return F.when(F.length(s) >= 4, s).otherwise(F.lpad(s, 4, "0"))


def rate(count: Column, exposure: Column, unit: float = 90.0) -> Column:
    """count per `unit` of exposure; null without exposure."""
    return count / F.nullif(exposure / unit, F.lit(0.0))


def guarded_ratio(successes: Column, attempts: Column) -> Column:
    """Three cases: attempts above 0 give the ratio, 0 attempts give 0, missing attempts give null."""
    return F.when(attempts > 0, successes / attempts).when(attempts.isNotNull(), F.lit(0.0))


def has_label(labels: Column, label: str) -> Column:
    """1 if a comma-joined set holds the label, else 0; a null set holds none."""
    return F.coalesce(F.array_contains(F.split(labels, ","), label), F.lit(False)).cast("int")


def log_at_least_one(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1.0)))


def unite_labels(labels: Column) -> Column:
    """Sorted union of comma-joined label sets, joined again (an aggregate)."""
    each = F.transform(F.flatten(F.collect_list(F.split(labels, ","))), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(each, lambda x: x != ""))), ",")


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean of x with weights w of the rows that have x; null without weight."""
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def merge_sources(df: DataFrame, key: list[str], counts: list[str], source: str, exposure: str, labels: str, mean: str) -> DataFrame:
    """One row a key: counts summed (all missing gives missing), the source with most exposure (least name on ties),
    the number of sources, the united label set, and the exposure-weighted mean of what is an average already."""
    main = F.min_by(F.col(source), F.struct((-F.coalesce(F.col(exposure), F.lit(0.0))).alias("a"), F.col(source).alias("b")))
    return df.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in counts], main.alias(f"{source}_main"), F.size(F.collect_set(source)).cast("long").alias(f"n_{source}s"),
        unite_labels(F.col(labels)).alias(labels), weighted_mean(F.col(mean), F.coalesce(F.col(exposure), F.lit(0.0))).alias(mean),
    )


def shrink(df: DataFrame, successes: str, attempts: str, out: str, k: float = 10.0) -> DataFrame:
    """Rate shrunk to the pooled rate by k prior attempts. The pooled rate is one row, broadcast."""
    pooled = df.agg((F.sum(successes) / F.sum(attempts)).alias("__pooled"))
    return df.crossJoin(F.broadcast(pooled)).withColumn(out, (F.col(successes) + k * F.col("__pooled")) / (F.col(attempts) + k)).drop("__pooled")


def shrunk(successes: str, attempts: str, pooled: float | None, k: float = 10.0) -> Column:
    """The rate of `shrink`, for a pooled rate that is known."""
    return (F.col(successes) + k * F.lit(pooled).cast("double")) / (F.col(attempts) + k)


def scale_table(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(group, variable, median, aad): mean absolute deviation about the median; where that is 0 or null the standard deviation, else 1."""
    group = F.col(by).cast("string") if by else F.lit("ALL")
    long = df.select(group.alias("group"), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("variable", "x"))
    half = exact_quantiles(long, ["group", "variable"], "x", [0.5]).select("group", "variable", F.col("q")[0].alias("median"))
    med = half.join(long.groupBy("group", "variable").agg(F.stddev_samp("x").alias("__sd")), ["group", "variable"])
    dev = long.join(med, ["group", "variable"]).groupBy("group", "variable", "median", "__sd").agg(F.avg(F.abs(F.col("x") - F.col("median"))).alias("aad"))
    return dev.select("group", "variable", "median", F.coalesce(F.nullif("aad", F.lit(0.0)), F.nullif("__sd", F.lit(0.0)), F.lit(1.0)).alias("aad"))


def pooled_medians(df: DataFrame, columns: list[str], near: float = 1e-3) -> dict[str, float]:
    """Exact medians of the columns that have values, all together: sketches give bounds on both sides of the middle, and the values between them (a share of about 2 * near, and ties) are counted.

    Where bounds turn out not to enclose the middle, or values are NaN, the median comes from `exact_quantiles`.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    sketch = F.array(F.lit(0.5 - near), F.lit(0.5 + near))
    row = df.agg(F.count(F.lit(1)), *[e.alias(f"{n}_{c}") for c, v in x.items() for n, e in (("n", F.count(v)), ("nan", F.count_if(F.isnan(v))), ("b", F.percentile_approx(v, sketch, F.lit(round(5 / near)))))]).first()
    held = [c for c in columns if row[f"n_{c}"]]
    bounds = {c: row[f"b_{c}"] for c in held if not row[f"nan_{c}"]}
    out: dict[str, float] = {}
    if bounds:
        inside = {c: x[c].between(F.lit(a), F.lit(b)) for c, (a, b) in bounds.items()}
        below = df.agg(*[F.count_if(x[c] < F.lit(a)).alias(c) for c, (a, _) in bounds.items()]).first()
        rest = reduce(DataFrame.unionAll, [df.where(w).select(F.lit(c).alias("c"), x[c].alias("x")) for c, w in inside.items()]).groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
        start = F.create_map(*[F.lit(v) for c in bounds for v in (c, below[c])])
        middle = F.create_map(*[F.lit(v) for c in bounds for v in (c, row[f"n_{c}"] - 1)])
        end = F.element_at(start, F.col("c")) + F.sum("n").over(Window.partitionBy("c").orderBy("x"))
        low, high = F.floor(F.element_at(middle, F.col("c")) / 2), F.ceil(F.element_at(middle, F.col("c")) / 2)
        holds = lambda k: (F.col("end") > k) & (F.col("end") - F.col("n") <= k)
        ends: dict[str, list] = {}
        for r in rest.withColumn("end", end).withColumns({"low": holds(low), "high": holds(high)}).where("low or high").collect():  # at most two rows a column
            own = ends.setdefault(r["c"], [None, None])
            own[0], own[1] = (r["x"] if r["low"] else own[0]), (r["x"] if r["high"] else own[1])
        out = {c: a + (b - a) * ((row[f"n_{c}"] - 1) % 2 / 2) for c, (a, b) in ends.items() if a is not None and b is not None}
    missing = [c for c in held if c not in out]
    if missing:
        long = df.select(F.explode(F.create_map(*[v for c in missing for v in (F.lit(c), x[c])])).alias("variable", "x"))
        out |= {r["variable"]: r["m"] for r in exact_quantiles(long, ["variable"], "x", [0.5]).select("variable", F.col("q")[0].alias("m")).collect()}
    return out


def pooled_scales(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The scales of `scale_table` over all rows: medians of all columns together, then deviations and standard deviations in one pass. A row a column reaches the driver."""
    medians = pooled_medians(df, columns)
    row = df.agg(F.count(F.lit(1)), *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c, m in medians.items() for n, f in (("d", lambda x, m=m: F.avg(F.abs(x - m))), ("s", F.stddev_samp))]).first()
    return {c: (row[f"d_{c}"] or row[f"s_{c}"] or 1.0) if c in medians else None for c in columns}


def scaled_by(df: DataFrame, scales: dict[str, float | None], prefix: str = "s_") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": F.col(c) / F.lit(x).cast("double") for c, x in scales.items()})


def add_scaled(df: DataFrame, columns: list[str], table: DataFrame | None = None, prefix: str = "s_") -> DataFrame:
    """df with each column divided by its pooled scale: that of a table, of which one row is broadcast, or df's own."""
    if table is None:
        return scaled_by(df, pooled_scales(df, columns), prefix)
    wide = table.where("`group` = 'ALL'").agg(*[F.max(F.when(F.col("variable") == c, F.col("aad"))).alias(f"__{c}") for c in columns])
    return df.crossJoin(F.broadcast(wide)).withColumns({f"{prefix}{c}": F.col(c) / F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def complete_rows(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all of the columns, rows that lack one)."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.where(~missing), df.where(missing)


def gap_aware_lead(df: DataFrame, entity: str, index: str, columns: list[str], suffix: str = "_next") -> DataFrame:
    """Values of the entity's next row, only where its index is the next one."""
    w = Window.partitionBy(entity).orderBy(index)
    follows = F.lead(index).over(w) == F.col(index) + 1
    return df.withColumns({f"{c}{suffix}": F.when(follows, F.lead(c).over(w)) for c in columns} | {"has_next": F.coalesce(follows, F.lit(False))})


def consecutive_pairs(df: DataFrame, entity: str | list[str], index: str, columns: list[str], left: str = "_t", right: str = "_t1") -> DataFrame:
    """Self join of each row with the entity's row of the next index."""
    keys = [entity] if isinstance(entity, str) else entity
    a = df.select(*keys, F.col(index), *[F.col(c).alias(c + left) for c in columns])
    b = df.select(*keys, (F.col(index) - 1).alias(index), *[F.col(c).alias(c + right) for c in columns])
    return a.join(b, [*keys, index])


def one_hot(df: DataFrame, column: str, levels: list, prefix: str) -> DataFrame:
    """0/1 columns of all sorted levels but the first."""
    return df.withColumns({f"{prefix}_{x}": (F.col(column) == x).cast("int") for x in sorted(levels)[1:]})


def clip_between(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """Winsorise at two exact quantiles (linear interpolation)."""
    bounds = exact_quantiles(df, [], column, [low, high]).select(F.col("q")[0].alias("__low"), F.col("q")[1].alias("__high"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.least(F.greatest(column, F.col("__low")), F.col("__high"))).drop("__low", "__high")


def coverage(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, rows, share of rows that have each column), with a total row of a null group."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_share") for c in columns])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, mean, sd, min, median, max); the median is exact."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("variable", "x"))
    half = exact_quantiles(long, ["variable"], "x", [0.5]).select("variable", F.col("q")[0].alias("median"))
    sums = long.groupBy("variable").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    return sums.join(half, "variable", "left").select("variable", "n", "mean", "sd", "min", "median", "max")


def near_constant(df: DataFrame, columns: list[str], least: float = 1e-10) -> list[str]:
    """Columns, in order and once each, whose standard deviation is above `least`. One row reaches the driver."""
    unique = list(dict.fromkeys(columns))
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in unique]).first()
    return [c for c in unique if row[c] is not None and row[c] > least]


#: Named sample variations: predicates over a table of consecutive pairs.
VARIATIONS = {
    "all": "true", "stayers": "club_main_t = club_main_t1", "nonzero": "value_t <> value_t1", "both_exposed": "minutes_t >= 500 and minutes_t1 >= 500",
    "without_last": "season <> 2000", "few_sources": "n_clubs_t <= 2",
}
