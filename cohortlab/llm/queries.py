"""The registered queries of this subpackage, each over whole tables, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, language_model, near_dedup, packing, pieces, quality, secrets, shared, tokens, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark_near_duplicates(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With `audited_recall`: the share of links found of a sample of vectors, by brute force over all rows (null without links)."""
    vectors = _table(spark, sf_dir, "embeddings")
    marked = shared.materialize(embedding_dedup.mark_near_vectors(vectors), "marked-vectors")
    return marked.withColumn("audited_recall", F.lit(embedding_dedup.audit_recall(vectors, marked)).cast("double"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.span_string(base), 256).alias("base_sha256"), secrets.span_string(F.col("secret_spans")).alias("spans"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table_digest(_table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole texts of `documents` (key doc_id) and of `conversations` (key conv_id, turn); the other table's keys are null."""
    both = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), allowMissingColumns=True)
    return pieces.sample_pieces(both, tokens.tokenizer_path("piece_bpe_32k.model"), ["doc_id", "conv_id", "turn"], with_ids=False)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")).drop("reputation")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_embedding_near_dedup, op3_secret_scan, op4_token_files, op5_quality_classifier, op6_sampled_pieces, op7_url_filter, op8_exact_dedup, op9_best_fit_packing, op10_lm_scoring)}

_REPUTATION_LEVEL = """
  {key}_groups AS (SELECT {columns}, SUM(n) AS n, SUM(bad) AS bad FROM hosts GROUP BY {columns}),
  {key}_above AS (SELECT g.*, {prior} AS prior FROM {key}_groups g {join}),
  {key}_k AS (SELECT 1 / least(greatest(CASE WHEN b = 0 OR b IS NULL THEN 0.999 ELSE (s - a) / b END, 0.001), 0.999) - 1 AS k FROM (
    SELECT SUM(pow(bad - n * prior, 2)) AS s, SUM(n * prior * (1 - prior)) AS a, SUM(n * (n - 1) * prior * (1 - prior)) AS b FROM {key}_above)),
  {key}_level AS (SELECT {key}_above.*, (bad + k * prior) / (n + k) AS mean, k FROM {key}_above, {key}_k)"""

ORACLE_SQL = {
    "op7_url_filter": r"""
WITH raw AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
  outcome AS (SELECT doc_id, MAX(CASE WHEN quality = 0 OR toxic > 0 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  counted AS (SELECT host, COUNT(o.bad) AS n, COALESCE(SUM(o.bad), 0) AS bad FROM parsed p LEFT JOIN outcome o ON p.page_id = o.doc_id GROUP BY host),
  named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM counted),
  cut AS (SELECT host, name, n, bad, labels, regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') AS address, CASE WHEN len(labels) >= 3 AND length(labels[-1]) = 2 AND list_contains(['ac', 'co', 'com', 'edu', 'gov', 'net', 'org'], labels[-2]) THEN 2 ELSE 1 END AS k FROM named),
  hosts AS (SELECT host, n, bad, CASE WHEN address THEN 'address' ELSE array_to_string(labels[greatest(1, len(labels) - k + 1):], '.') END AS suffix,
    CASE WHEN address THEN name ELSE array_to_string(labels[greatest(1, len(labels) - k):], '.') END AS domain FROM cut),"""
    + ",".join(
        [
            _REPUTATION_LEVEL.format(key="suffix", columns="suffix", prior="(SELECT (SUM(bad) + 0.5) / (SUM(n) + 1) FROM hosts)", join=""),
            _REPUTATION_LEVEL.format(key="domain", columns="suffix, domain", prior="l.mean", join="JOIN suffix_level l USING (suffix)"),
            _REPUTATION_LEVEL.format(key="host", columns="suffix, domain, host", prior="l.mean", join="JOIN domain_level l USING (suffix, domain)"),
        ]
    )
    + r""",
  rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
  fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, COALESCE(f.verdict, CASE WHEN h.mean - 1.645 * sqrt(h.mean * (1 - h.mean) / (h.n + h.k + 1)) > 0.15 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p JOIN host_level h USING (host) LEFT JOIN fits f USING (page_id)""",
    "op8_exact_dedup": """
SELECT doc_id, MAX(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size, doc_id = MAX(doc_id) OVER same AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY COALESCE(text, ''))""",
}
