"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes each text to a position of a sparse counting filter (one probe among 2**40 positions) and keeps the
positions hit at least twice. What it exchanges is one position of 8 bytes for each distinct text of a task, counted within the task first; no row and no text moves.
The positions kept fill a dense, blocked Bloom filter, which is broadcast up to 64 MB and joined by block beyond. Pass 2 probes it: rows it
denies are unique and pass straight through, and only the possibly repeated rows are shuffled, grouped by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import build_bloom, materialize, probe_bloom, sized_join

OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]


def mark_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, position_bits: int = 40) -> DataFrame:
    """Every row of df with keep_id (id of the row that stays among equal texts: the largest), group_size, kept and text_sha256.

    carry: the columns of df to return (default: all). Null texts count as empty. Rows with equal text and equal id are told
    apart by their place, and one of them stays. A null id is below every other. Columns of df named like an output
    column are replaced. An empty df gives an empty result.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c not in OUTPUT]
    text = F.coalesce(F.col(text_col), F.lit(""))
    position = F.xxhash64(text).bitwiseAND(F.lit((1 << position_bits) - 1).cast("long"))
    twice = df.select(position.alias("__pos")).groupBy("__pos").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__pos")
    bloom = build_bloom(materialize(twice, "repeated"), "__pos")
    keep = [F.col(c) for c in dict.fromkeys([*carry, id_col])]
    rows = probe_bloom(df.select(*keep, position.alias("__pos"), F.sha2(text, 256).alias("text_sha256")), "__pos", bloom, "__maybe")
    unique = rows.where("not __maybe").select(*carry, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = materialize(rows.where("__maybe").drop("__maybe", "__pos").withColumn("__row", F.monotonically_increasing_id()), "maybe-repeated")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct(F.col(id_col).alias("i"), F.col("__row").alias("r"))).alias("__top"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "copies")
    joined = sized_join(maybe, groups, ["text_sha256"], "group_size", maybe.count())
    repeated = joined.select(*carry, F.col("__top.i").alias("keep_id"), "group_size", (F.col("__row") == F.col("__top.r")).alias("kept"), "text_sha256")
    return unique.unionByName(repeated)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without repeated texts: of equal texts the row with the largest id stays, with the columns of df."""
    own = {c: f"__own_{c}" for c in df.columns if c in OUTPUT}
    held = df.withColumnsRenamed(own)
    out = mark_exact_duplicates(held, own.get(id_col, id_col), own.get(text_col, text_col)).where("kept").drop(*OUTPUT)
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*df.columns)
