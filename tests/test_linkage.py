"""Blocked matching of many rows with the same name and year, against all pairs of rows."""

from pyspark.sql import functions as F

from cohortlab.operators import linkage as L
from cohortlab.operators.contracts import keep_best


def _rows(spark):
    names = ["red bolt", "bolt red", "red nut", "old red bolt", None]
    left = spark.range(300).select((F.col("id") % 3).alias("block"), "id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 5 + 1).cast("int")).alias("name"), F.when(F.col("id") % 11 > 0, (F.col("id") % 7).cast("int")).alias("year"))
    right = spark.range(300).select((F.col("id") % 4).alias("block"), (1000 - F.col("id")).alias("cand"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 5 + 1).cast("int")).alias("cand_name"), F.when(F.col("id") % 13 > 0, (F.col("id") % 9).cast("int")).alias("cand_year"))
    return left, right


def _pairs(left, right):
    near = F.col("year").isNull() | F.col("cand_year").isNull() | (F.abs(F.col("year") - F.col("cand_year")) <= 1)
    return left.join(right, "block").where(near)


def test_matches_of_repeated_rows(spark):
    left, right = _rows(spark)
    gap = F.when(F.col("year").isNull() | F.col("cand_year").isNull(), 2).otherwise(F.abs(F.col("year") - F.col("cand_year")))
    scored = _pairs(left, right).where("name is not null and cand_name is not null").withColumn("score", L.match_score(F.col("name"), F.col("cand_name"))).withColumn("year_gap", gap)
    best = keep_best(scored, ["id", "block"], [F.desc("score"), F.col("year_gap"), F.col("cand")]).where("score >= case year_gap when 0 then 70 when 1 then 85 else 92 end")
    columns = ["id", "block", "name", "year", "cand", "cand_name", "cand_year", "score", "year_gap"]
    found = L.match_blocked(left, right, ["block"], "id", "cand", "name", "cand_name", "year", "cand_year")
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, best.select(*columns).collect())) and found.count() > 50


def test_counts_of_candidates(spark):
    left, right = _rows(spark)
    want = _pairs(left, right).groupBy("id").agg(F.count(F.lit(1)).alias("candidates"), F.min("cand").alias("first"))
    found = L.count_candidates(left, right, ["block"], "id", "cand", "year", "cand_year")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
