"""Relational operators with stated contracts: checked joins, keep-best, key exclusion, upserts, set operations, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join key is repeated on a side that has to be unique."""


def repeated_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:1", null_safe: bool = False) -> DataFrame:
    """Join after checking that the sides named by 1 in `validate` (`1:1`, `m:1`, `1:m`, `m:m`) have no repeated key.

    null_safe: null keys match null keys. The check is a grouped count that stops at the first repeated key.
    """
    one_left, one_right = validate.split(":")
    for side, df, one in (("left", left, one_left), ("right", right, one_right)):
        if one == "1" and not repeated_keys(df, on).isEmpty():
            raise CardinalityError(f"{side} side repeats a key of {on}; expected {validate}")
    if not null_safe:
        return left.join(right, on, how)
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def keep_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which has to be total for a stable result."""
    best = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", best).where("__rank = 1").drop("__rank")


def drop_ambiguous(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is unique, repeated keys with their counts): no row of a repeated key stays."""
    bad = repeated_keys(df, key)
    return df.join(bad.select(*key), key, "left_anti"), bad


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not in `new`; columns that one side lacks are null."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def remaining_work(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned units that a checkpoint doesn't hold yet (resume)."""
    return planned.join(done.select(*key), key, "left_anti")


def key_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*key).distinct().join(right.select(*key), key, "left_anti")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left beyond their number in right, with repeats."""
    return left.exceptAll(right)


def exactly_one(df: DataFrame, condition: Column, key: list[str]) -> DataFrame:
    """The row of each key that meets the condition; fails at run time where a key has more than one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    found = df.where(condition).withColumn("__n", n)
    return found.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row matches"))).otherwise(True).cast("boolean")).drop("__n")


def funnel(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, name, rows) of each step of a sample selection."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "rows") for i, (name, df) in enumerate(steps)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def fill_from_priority(df: DataFrame, priority: Column, order: list[Column], n: int) -> DataFrame:
    """The rows marked by `priority` first, then the others in order, n in all."""
    return df.orderBy(priority.desc(), *order).limit(n)
