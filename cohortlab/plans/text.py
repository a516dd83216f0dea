"""Registered queries: text audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import textdiff as T
from ..sources.io import table
from .base import Registry

registry = Registry()
add = registry.add
Spark = SparkSession
NUMBER = T.PATTERNS["numbers"]
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
# RE2 has neither look-around nor back references: comments keep the character before them, environments are spelt out, and sentence ends get a mark
_STRIPPED = lambda t: rf"regexp_replace({t}, '(^|[^\\])%[^\n]*', '\1', 'g')"
_ENV = lambda n: rf"\\begin\{{{n}\}}.*?\\end\{{{n}\}}".replace("*", r"\*").replace(r".\*?", ".*?")
_CLEAN = lambda t: f"regexp_replace({_STRIPPED(t)}, '{'|'.join(map(_ENV, T.NO_SENTENCES))}', ' ', 'gs')"
_PARTS = lambda t: rf"string_split(regexp_replace(regexp_replace({_CLEAN(t)}, '{T.SPACE}+', ' ', 'g'), '([.!?]) ([A-Z\\$])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_SENTENCES = lambda t: f"list_filter(list_transform({_PARTS(t)}, lambda s: trim(s, ' ')), lambda s: length(s) > 25)"
_EDITED = "replace(replace(text, '1', '7'), ' the ', ' a ')"


def docs(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def edited(df: DataFrame) -> DataFrame:
    """A second version: another spelling of a year digit and of a word."""
    return df.withColumn("text", F.replace(F.replace("text", F.lit("1"), F.lit("7")), F.lit(" the "), F.lit(" a ")))


@add("tx1_strip_comments", f"SELECT doc_id, sha256({_CLEAN('text')}) AS sha FROM documents")
def _(spark: Spark, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2(T.clean(F.col("text")), 256).alias("sha"))


@add("tx2_sentences", f"WITH sent AS (SELECT doc_id, unnest({_SENTENCES('text')}) AS s FROM documents) SELECT doc_id, COUNT(*) AS n, CAST(SUM(length(s)) AS BIGINT) AS chars, MIN(s) AS first FROM sent GROUP BY doc_id")
def _(spark: Spark, sf: str) -> DataFrame:
    s = docs(spark, sf).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"), F.min("s").alias("first"))


def _term_sql(text: str) -> str:
    said = f"(SELECT doc_id, lower(array_to_string({_SENTENCES(text)}, ' ')) AS low FROM documents)"
    terms = f"(SELECT unnest([{', '.join(map(_QUOTED, T.TERMS))}]) AS term)"
    return f"SELECT doc_id, term, n FROM (SELECT doc_id, term, CAST((length(low) - length(replace(low, term, ''))) / length(term) AS BIGINT) AS n FROM {said}, {terms}) WHERE n > 0"


@add("tx3_term_counts", _term_sql("text"))
def _(spark: Spark, sf: str) -> DataFrame:
    return T.term_counts(docs(spark, sf), "doc_id", "text")


@add("tx3_term_changes", f"SELECT doc_id, term, COALESCE(a.n, 0) AS before, COALESCE(b.n, 0) AS after FROM ({_term_sql('text')}) a FULL JOIN ({_term_sql(_EDITED)}) b USING (doc_id, term) WHERE COALESCE(a.n, 0) <> COALESCE(b.n, 0)")
def _(spark: Spark, sf: str) -> DataFrame:
    before = docs(spark, sf)
    return T.count_changes(T.term_counts(before, "doc_id", "text"), T.term_counts(edited(before), "doc_id", "text"), ["doc_id", "term"])


@add("tx4_numbers", rf"SELECT doc_id, item, COUNT(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{NUMBER}')) AS item FROM documents) GROUP BY doc_id, item")
def _(spark: Spark, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("item")).groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n"))


def _changed(spark: Spark, sf: str) -> DataFrame:
    before = docs(spark, sf)
    both = edited(before.withColumn("a", T.sentences(F.col("text")))).select("doc_id", "a", T.sentences(F.col("text")).alias("b"))
    return T.changed_within(both, "doc_id", "a", "b")


@add("tx5_changed_sentences")
def _(spark: Spark, sf: str) -> DataFrame:
    """Whole texts of all documents; one document is matched in one task."""
    return _changed(spark, sf)


@add("tx5_claims_to_read")
def _(spark: Spark, sf: str) -> DataFrame:
    return T.claim_changes(_changed(spark, sf))


def _items_sql(text: str) -> str:
    """(doc_id, category, item, n) of all categories of protected items."""
    t = "t"
    plain = rf"regexp_replace({t}, '\\[a-zA-Z]+\*?(\[[^\]]*\])?\{{[^}}]*\}}', ' ', 'g')"
    every = lambda p, of=t, group=0: f"regexp_extract_all({of}, {_QUOTED(p)}, {group})"
    blocks = [every("(?s)" + _ENV(n)) for n in T.ENVIRONMENTS] + [every(r"(?s)\\\[.*?\\\]")]
    found = {"blocks": " || ".join(blocks)} | {k: every(p, plain if k == "numbers" else t, int(k == "environments")) for k, p in T.PATTERNS.items()}
    found["dashes"] = "list_filter(regexp_extract_all(t, '-+'), lambda x: length(x) IN (2, 3))"
    union = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category, unnest({v}) AS item FROM versions" for k, v in found.items())
    return f"SELECT doc_id, category, trim(regexp_replace(item, '{T.SPACE}+', ' ', 'g'), ' ') AS item, COUNT(*) AS n FROM (WITH versions AS (SELECT doc_id, {_STRIPPED(text)} AS t FROM documents) {union}) GROUP BY ALL"


@add("tx6_protected_items", _items_sql("text"))
def _(spark: Spark, sf: str) -> DataFrame:
    return T.extract_items(docs(spark, sf), "doc_id", "text").groupBy("doc_id", "category", "item").agg(F.count(F.lit(1)).alias("n"))


@add("tx7_verdicts", f"""WITH d AS (SELECT doc_id, SUM(greatest(COALESCE(a.n, 0) - COALESCE(b.n, 0), 0)) AS removed, SUM(greatest(COALESCE(b.n, 0) - COALESCE(a.n, 0), 0)) AS added
  FROM ({_items_sql('text')}) a FULL JOIN ({_items_sql(_EDITED)}) b USING (doc_id, category, item) GROUP BY doc_id)
SELECT doc_id, CAST(COALESCE(removed, 0) AS BIGINT) AS removed, CAST(COALESCE(added, 0) AS BIGINT) AS added, CASE WHEN COALESCE(removed + added, 0) = 0 THEN 'OK' ELSE 'CHECK' END AS verdict FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN d USING (doc_id)""")
def _(spark: Spark, sf: str) -> DataFrame:
    """All categories of protected items."""
    before = docs(spark, sf)
    items = lambda df: T.extract_items(df, "doc_id", "text")
    return T.verdicts(T.multiset_changes(items(before), items(edited(before)), ["doc_id", "category", "item"]), before, "doc_id")
