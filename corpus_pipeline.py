"""A corpus pipeline of five stages: quality filter, exact and near deduplication, secret redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import exact_dedup, near_dedup, packing, quality, secrets, shared, tokens


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject, with all columns of docs, whatever their names.

    Null and empty texts have the score of a text without n-grams, so they stay or go together; repeated rows are judged alike; an empty table stays empty.
    """
    own = {c: f"__own_{c}" for c in ("score", "predicted") if c in docs.columns}
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.score(docs.withColumnsRenamed(own), model).where("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest doc_id, with all its columns.

    Null texts count as empty ones, so one of both stays; of rows with equal text and id one stays; a null id is below every other.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id, with all its columns.

    Texts without words, null and empty ones included, are near-duplicates of equal ones only; a text of fewer than five words is one run of words.
    """
    return near_dedup.near_dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted anew where a text was changed; null and empty texts and all other columns stay as they are."""
    return secrets.redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens; a null or empty text is one piece of the end id alone."""
    return packing.pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_filter), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("secret scans", redact_secrets), ("best-fit packing", pack)]

#: The classifier, the signatures, the randomness battery and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's result written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


