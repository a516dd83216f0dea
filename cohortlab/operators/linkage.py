"""Record linkage: blocked fuzzy matching, nearest-date joins, majority votes and identity resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import token_set_ratio, token_sort_ratio
from .contracts import keep_best


def nearest_date(events: DataFrame, targets: DataFrame, key: str, date: str, target: str, tolerance_days: int, tie: list[Column]) -> DataFrame:
    """Of the events of a target's key within the tolerance (inclusive) the nearest, ties in the given order.

    targets: (key, period, target date). Each event is joined with the targets of its key only, and the best is an aggregate (min_by), not a sort.
    """
    gap = F.abs(F.datediff(F.col(date), F.col(target)))
    near = events.where(F.col(date).isNotNull()).join(targets, key).withColumn("gap", gap).where(F.col("gap") <= tolerance_days)
    rest = [c for c in near.columns if c not in (key, target)]
    best = near.groupBy(key, target).agg(F.min_by(F.struct(*rest), F.struct("gap", *tie)).alias("__best"))
    return best.select(key, target, "__best.*").select(*near.columns)


def match_score(a: Column, b: Column) -> Column:
    """The better of the sorted-token ratio and the token-set ratio less 5."""
    return F.greatest(token_sort_ratio(a, b), token_set_ratio(a, b) - 5)


def _same(a: list[str], b: list[str]) -> Column:
    """Equal values of the columns, null with null."""
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)])


def near_years(left: DataFrame, right: DataFrame, left_year: str, right_year: str) -> DataFrame:
    """(__ly, __ry, year_gap): the pairs of distinct years that may match: within one (gap 0 or 1), or one of them lacks (2)."""
    ly, ry = F.col("__ly"), F.col("__ry")
    both = left.select(F.col(left_year).alias("__ly")).distinct().crossJoin(F.broadcast(right.select(F.col(right_year).alias("__ry")).distinct()))
    lacks = ly.isNull() | ry.isNull()
    return both.where(lacks | (F.abs(ly - ry) <= 1)).withColumn("year_gap", F.when(lacks, 2).otherwise(F.abs(ly - ry)))


def _by_year(left: DataFrame, right: DataFrame, block: list[str], left_year: str, right_year: str) -> DataFrame:
    """left joined with right on the block and the years that may match, all of them equi-joins."""
    years = near_years(left, right, left_year, right_year)
    open_ = left.join(F.broadcast(years), _same([left_year], ["__ly"])).drop("__ly")
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in block})
    on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__{c}") for c in block])
    return open_.join(renamed, on & _same(["__ry"], [right_year])).drop("__ry", *[f"__{c}" for c in block])


def match_blocked(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, left_name: str, right_name: str, left_year: str, right_year: str, thresholds: tuple[float, float, float] = (70.0, 85.0, 92.0)) -> DataFrame:
    """Best candidate of each left row within its block, where its score passes the threshold for its kind of year match.

    Candidates share the block and lie within one year, or have no year; a left row without a year sees all. thresholds: same year, off by one, unknown.
    Rows of one block, name and year have one best candidate, and of those on the right only the first can be it, so pairs are formed of distinct (block, name, year) only.
    """
    rest = [c for c in right.columns if c not in (*block, right_name, right_year, right_id)]
    key = [*block, left_name, left_year]
    sees = left.where(F.col(left_name).isNotNull()).select(*key).distinct()
    seen = right.where(F.col(right_name).isNotNull()).groupBy(*block, right_name, right_year).agg(F.min(F.struct(right_id, *rest)).alias("__first"))
    own = _by_year(sees, seen, block, left_year, right_year).groupBy(*key, right_name).agg(F.min(F.struct("year_gap", "__first", right_year)).alias("__first"))
    names = own.select(left_name, right_name).distinct().withColumn("score", match_score(F.col(left_name), F.col(right_name)))
    scored = own.join(names, [left_name, right_name])
    order = F.struct((-F.col("score")).alias("a"), F.col("__first.year_gap").alias("b"), F.col(f"__first.__first.{right_id}").alias("c"))
    best = scored.groupBy(*key).agg(F.min_by(F.struct("score", F.col("__first.year_gap").alias("year_gap"), F.col(right_name), F.col(f"__first.{right_year}").alias(right_year), F.col("__first.__first").alias("__first")), order).alias("__best"))
    renamed = best.withColumnsRenamed({c: f"__{c}" for c in key})
    rows = left.join(renamed, _same(key, [f"__{c}" for c in key])).select(*left.columns, "__best.*").select(*left.columns, right_name, right_year, "__first.*", "score", "year_gap")
    found = keep_best(rows, [left_id, *block], [F.desc("score"), F.col("year_gap"), F.col(right_id)])
    limit = F.when(F.col("year_gap") == 0, thresholds[0]).when(F.col("year_gap") == 1, thresholds[1]).otherwise(thresholds[2])
    return found.where(F.col("score") >= limit)


def count_candidates(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, left_year: str, right_year: str) -> DataFrame:
    """(left id, candidates, first): how many right rows of its block lie within one year of a left row or lack a year, and the least id. Counted by block and year, so no pair of rows is formed."""
    sees, seen = left.select(*block, left_year).distinct(), right.groupBy(*block, right_year).agg(F.count(F.lit(1)).alias("__n"), F.min(right_id).alias("__first"))
    counted = _by_year(sees, seen, block, left_year, right_year).groupBy(*block, left_year).agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))
    key = [*block, left_year]
    rows = left.join(counted.withColumnsRenamed({c: f"__{c}" for c in key}), _same(key, [f"__{c}" for c in key]))
    return rows.groupBy(left_id).agg(F.sum("__n").alias("candidates"), F.min("__first").alias("first"))


def majority_vote(matches: DataFrame, entity: list[str], vote: str, score: str) -> DataFrame:
    """(entity, vote, n, score): the id matched most often, then by the best score, then the least."""
    counted = matches.groupBy(*entity, vote).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias(score))
    return keep_best(counted, entity, [F.desc("n"), F.desc(score), F.col(vote)])


def resolve_identities(rows: DataFrame, ident: str, key: str, period: str, name: str, year: str, score: str, weight: str, least_similarity: float = 90.0) -> DataFrame:
    """(ident, key, same_person, keeps_ident) of each key of an id that several keys share.

    The keys are one person if they never meet in a period, their names are all at least `least_similarity` alike and their years differ by at most one.
    Otherwise the key with the best (score, weight) keeps the id. An id has a handful of keys, so pairs within it are few.
    """
    keys = rows.groupBy(ident, key).agg(F.min(name).alias("name"), F.min(year).alias("year"), F.max(score).alias("score"), F.sum(weight).alias("weight"))
    shared = keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(ident))).where("n > 1").drop("n")
    meet = rows.groupBy(ident, period).agg(F.countDistinct(key).alias("n")).groupBy(ident).agg((F.max("n") > 1).alias("meets"))
    a, b = shared.select(ident, F.col(key).alias("ka"), F.col("name").alias("na")), shared.select(ident, F.col(key).alias("kb"), F.col("name").alias("nb"))
    alike = a.join(b, ident).where("ka < kb").withColumn("s", token_set_ratio(F.col("na"), F.col("nb"))).groupBy(ident).agg(F.min("s").alias("alike"))
    span = shared.groupBy(ident).agg((F.max("year") - F.min("year")).alias("span"))
    facts = meet.join(alike, ident).join(span, ident).select(ident, (~F.col("meets") & (F.col("alike") >= least_similarity) & (F.coalesce("span", F.lit(0)) <= 1)).alias("same_person"))
    first = F.row_number().over(Window.partitionBy(ident).orderBy(F.desc("score"), F.desc("weight"), F.col(key)))
    return shared.join(facts, ident).withColumn("keeps_ident", F.col("same_person") | (first == 1)).select(ident, key, "same_person", "keeps_ident")


def weak_matches(matches: DataFrame, reference: DataFrame, on: list[str], score: str = "score", below: float = 92.0) -> DataFrame:
    """Matches below a score with what the reference says on their keys; null keys match null keys."""
    renamed = reference.withColumnsRenamed({c: f"__{c}" for c in on})
    same = None
    for c in on:
        x = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = x if same is None else same & x
    return matches.where(F.col(score) < below).join(renamed, same, "left").drop(*[f"__{c}" for c in on])
