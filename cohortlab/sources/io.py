"""Sources and sinks: tables with stated schemas, cached pages and histories, optional inputs, result files."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see (spark.checkpoint.dir; a temporary one only where that is unset)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="cohortlab-io-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = f"file://{_own[0]}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what several later steps read is computed once, and plans stay short. The write's shuffle files go when it is done."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the configured paths that exists."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema; a value that doesn't fit is null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path, or an empty one with the schema where there is none."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def cached_pages(pages: DataFrame, html: str = "html", shortest: int = 5000) -> DataFrame:
    """Pages of a crawl's cache that are long enough to be whole. Fetching is left to the crawler that fills the table (url, html)."""
    return pages.where(F.length(html) >= shortest)


def page_links(pages: DataFrame, ident: str, html: str = "html") -> DataFrame:
    """(ident, href, name) of a page's links: one row an href, with the first name that isn't empty."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(2)).alias("name"))
    long = pages.select(ident, F.posexplode(found).alias("place", "x")).select(ident, "place", F.col("x.href").alias("href"), F.nullif(F.trim("x.name"), F.lit("")).alias("name"))
    return long.groupBy(ident, "href").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("place"))).alias("name"))


def page_records(pages: DataFrame, ident: str, html: str = "html") -> DataFrame:
    """(ident, record, title, year) of each paragraph: its text, and a year 19dd or 20dd that an age in parentheses follows, else null."""
    body = F.regexp_extract_all(html, F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    year = F.regexp_extract("raw", r"\b((?:19|20)\d\d) \(\d+\)", 1).try_cast("int")
    rows = pages.select(ident, F.posexplode(body).alias("record", "raw"))
    return rows.select(ident, "record", F.trim(F.regexp_replace("raw", "<[^>]*>", " ")).alias("title"), year.alias("year"))


def crawl(pages: DataFrame, ident: str, group: Column, html: str = "html") -> DataFrame:
    """(group, ident, href, name, record, title): records of all pages by group, flattened, with the page's first link."""
    links = page_links(pages, ident, html).groupBy(ident).agg(F.min(F.struct("href", "name")).alias("first"))
    records = page_records(pages.withColumn("__group", group), ident, html)
    grouped = pages.select(ident, group.alias("group"))
    return grouped.join(records, ident).join(links, ident, "left").select("group", ident, F.col("first.href").alias("href"), "record", "title")


def histories(df: DataFrame, text: str, schema: str, out: str = "history") -> DataFrame:
    """Parsed JSON; a corrupt text gives null, so it can be fetched again."""
    return df.withColumn(out, F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def run_summary(facts: dict) -> str:
    return json.dumps(facts, indent=2, sort_keys=True)


def latex_table(df: DataFrame, most_rows: int = 200, digits: int = 3) -> str:
    """A tabular of a small result; more than most_rows rows are an error, not cut."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    text = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    clean = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
    kinds = "".join("r" if isinstance(f.dataType, T.NumericType) else "l" for f in df.schema)
    lines = [" & ".join(clean(text(x)) for x in r) + r" \\" for r in (df.columns, *map(tuple, rows))]
    return "\n".join([rf"\begin{{tabular}}{{{kinds}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])


def bars(df: DataFrame, x: str, y: Column, name: str = "height") -> DataFrame:
    """Plot data of bars: one row a category."""
    return df.groupBy(x).agg(y.alias(name))


def histogram(df: DataFrame, x: str, width: float) -> DataFrame:
    """Plot data of a histogram: (left edge, count)."""
    return df.where(F.col(x).isNotNull()).groupBy((F.floor(F.col(x) / width) * width).alias("left")).agg(F.count(F.lit(1)).alias("n"))


def boxes(df: DataFrame, by: str, x: str) -> DataFrame:
    """Plot data of box plots: exact quartiles and extremes by group."""
    from ..operators.quantiles import exact_quantiles

    ends = df.groupBy(by).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    return ends.join(exact_quantiles(df, [by], x, [0.25, 0.5, 0.75]), by, "left").select(by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")
