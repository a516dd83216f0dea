"""Exact quantiles of large columns, by counting buckets around the wanted ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import staged

BUCKETS = 1024


def exact_quantiles(df: DataFrame, keys: list[str], x: str, probs: list[float], most: int = 1 << 20, out: str = "q") -> DataFrame:
    """(keys, q): exact quantiles, linearly interpolated, as an array in the order of probs. Nulls don't count; a group without values has no row.

    Groups of up to `most` rows go through the built-in, which holds a group's distinct values in one task. If any is larger, each wanted rank is enclosed in ever narrower
    bounds: a pass counts the values between them in 1024 buckets, pre-aggregated in every task, and the bucket that holds the rank gives the next bounds, down to a single value.
    """
    long = df.select(*keys, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    if not keys:
        long = long.withColumn("__one", F.lit(1))
    by = keys or ["__one"]
    sizes = staged(long.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high")), "sizes")
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= most:
        return long.groupBy(*by).agg(F.percentile("__x", F.array(*[F.lit(p) for p in probs])).alias(out)).select(*keys, out)
    place = F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(len(probs))]).alias("i"), F.array(*[F.lit(p) for p in probs]).alias("p"))).alias("w")
    wanted = sizes.select(*by, "__n", place).select(*by, F.col("w.i").alias("__i"), (F.col("w.p") * (F.col("__n") - 1)).alias("__at"))
    ranks = wanted.select(*by, F.explode(F.array(F.floor("__at").cast("long"), F.ceil("__at").cast("long"))).alias("__k")).distinct()
    state = staged(ranks.join(sizes, by).select(*by, "__k", "__low", "__high", F.lit(0).cast("long").alias("__base")), "bounds")
    width = F.col("__high") / BUCKETS - F.col("__low") / BUCKETS
    bucket = F.when(width > 0, F.least(F.floor(F.col("__x") / width - F.col("__low") / width), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    while not state.where("__low < __high").isEmpty():  # the bounds of each rank are values, and close in
        inside = long.join(state, by).where((F.col("__x") >= F.col("__low")) & (F.col("__x") <= F.col("__high")))
        counted = inside.groupBy(*by, "__k", "__base", bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
        upto = F.sum("__n").over(Window.partitionBy(*by, "__k").orderBy("__b"))  # at most 1024 rows a rank
        placed = counted.withColumn("__end", F.col("__base") + upto)
        holds = (F.col("__k") < F.col("__end")) & (F.col("__k") >= F.col("__end") - F.col("__n"))
        state = staged(placed.where(holds).select(*by, "__k", "__low", "__high", (F.col("__end") - F.col("__n")).alias("__base")), "bounds")
    value = lambda name, at: state.select(*by, F.col("__k").alias(at), F.col("__low").alias(name))
    ends = wanted.withColumns({"__a": F.floor("__at").cast("long"), "__c": F.ceil("__at").cast("long")}).join(value("__va", "__a"), [*by, "__a"]).join(value("__vc", "__c"), [*by, "__c"])
    found = ends.select(*by, F.struct("__i", (F.col("__va") + (F.col("__vc") - F.col("__va")) * (F.col("__at") - F.col("__a"))).alias("v")).alias("s"))
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"]).alias(out)).select(*keys, out)  # an entry a probability
