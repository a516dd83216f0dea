"""Spark helpers that the operators of this subpackage share: shared-folder tables, skew-safe joins, Bloom filters."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 32768  # bits of one bitmap of bitmap_construct_agg
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cohortlab-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cohortlab-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and no lost executor takes rows with it."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | (options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cohortlab-" in root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, parts: int = 2000) -> DataFrame:
    """Inner join of rows to one row a key, where groups[size] is the number of rows of the key.

    Groups above total / parts rows number fewer than `parts`, so broadcasting them is bounded; every other key has too
    few rows to make a task uneven and goes through an ordinary shuffle.
    """
    limit = max(64, total // parts)
    heavy, light = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    hot = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return hot.unionByName(rest)


@dataclass(frozen=True)
class Bloom:
    """A blocked Bloom filter over long keys: a table (__block, __bits) of 4 KB a block, and its number of blocks."""

    table: DataFrame
    blocks: int


#: Filters up to so many blocks, 64 MB, are broadcast.
BROADCAST_BLOCKS = 1 << 14


def build_bloom(keys: DataFrame, key: str) -> Bloom:
    """16 to 32 bits a key, however many keys there are, so the share of rows that pass by chance stays the same."""
    n, blocks = keys.count(), 1
    while blocks * BLOCK_BITS < 16 * n:
        blocks *= 2
    bits = keys.select(_block(F.col(key), blocks).alias("__block"), F.explode(F.array(*_probes(F.col(key)))).alias("__bit"))
    return Bloom(materialize(bits.groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "bloom"), blocks)


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(blocks - 1).cast("long"))


def _probes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long")) for i in (1, 2, 3)]


def probe_bloom(rows: DataFrame, key: str, bloom: Bloom, flag: str) -> DataFrame:
    """Add the boolean column `flag`: false means that the key is surely not among those of the filter.

    A filter of at most BROADCAST_BLOCKS blocks (64 MB) is broadcast, so no row is shuffled. A larger one, of more than about 30 million keys, is joined by block.
    """
    table = F.broadcast(bloom.table) if bloom.blocks <= BROADCAST_BLOCKS else bloom.table
    joined = rows.withColumn("__block", _block(F.col(key), bloom.blocks)).join(table, "__block", "left")
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("__bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    first, second, third = (F.floor(byte(bit) / F.pow(F.lit(2.0), bit % 8)) % 2 == 1 for bit in _probes(F.col(key)))
    return joined.withColumn(flag, F.coalesce(first & second & third, F.lit(False))).drop("__block", "__bits")
