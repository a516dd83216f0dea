"""Incremental versions of batch steps on Structured Streaming: windowed counts with late data, and a keyed upsert of a result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contracts import keep_best, upsert
from ..sources.io import exists


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, keys, n, total) of tumbling windows; rows later than the watermark are dropped, so the state stays bounded."""
    spans = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return spans.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Number and path of each version that was written to its end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    named = {s.getPath().getName(): s.getPath().toString() for s in files.listStatus(root)}
    return {int(n[1:]): p for n, p in named.items() if n.startswith("v") and n[1:].isdigit() and exists(spark, f"{p}/_SUCCESS")}


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of the last batch that was written to its end, or None before the first."""
    found = _versions(spark, path)
    return spark.read.parquet(found[max(found)]) if found else None


def upsert_stream(stream: DataFrame, path: str, key: list[str], checkpoint: str, order: list[Column], keep: int = 3) -> StreamingQuery:
    """Keep a table under `path` up to date with each batch's rows by key; of a batch's rows of one key the first in `order` counts, which has to be total. `upserted` reads it.

    Batch n writes version n, from the last whole version before it. A version counts from its _SUCCESS file on, which the writer's commit puts there last, so a batch that died half-way
    leaves the one before in force, and its repetition writes the same version anew. The last `keep` versions stay, for readers at work.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = _versions(spark, path)
        if number in found:  # a repeated batch
            return
        new, before = keep_best(batch, key, order), [n for n in found if n < number]
        if before:
            new = upsert(spark.read.parquet(found[max(before)]), new, key)
        new.write.mode("overwrite").parquet(f"{path}/versions/v{number:012d}")
        for n in sorted(before)[: max(0, len(before) + 1 - keep)]:
            old = spark._jvm.org.apache.hadoop.fs.Path(found[n])
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
