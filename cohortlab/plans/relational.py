"""Registered queries: sources, projections, filters, joins, aggregates, windows, order, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.strings import BASE, MARKED, SPELLED, normalize_name, token_set_ratio, token_sort_ratio
from ..operators import contracts as C
from ..operators import linkage as L
from ..operators import panel as P
from ..operators.quantiles import exact_quantiles
from ..sources import io
from .base import COUNTS, SCALED, Registry, panel, r, raw, rounded, sample, scaled_sample, variables, with_base

registry = Registry()
add = registry.add
Spark = SparkSession


# -- sources and sinks -------------------------------------------------------------------------------------------------------------


@add("src1_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark: Spark, sf: str) -> DataFrame:
    path = io.scratch_path(spark, "csv")
    io.write_csv(io.table(spark, sf, "nation"), path)
    return io.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@add("src2_first_existing", "SELECT r_regionkey, r_name FROM region")
def _(spark: Spark, sf: str) -> DataFrame:
    return spark.read.parquet(io.first_existing(spark, [f"{sf}/absent.parquet", f"{sf}/region.parquet"]))


@add("src3_cached_pages", "SELECT page_id, url, length(html) AS size FROM pages WHERE length(html) >= 3000")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.cached_pages(io.table(spark, sf, "pages"), shortest=3000).select("page_id", "url", F.length("html").cast("long").alias("size"))


_LINKS = r"""links AS (SELECT page_id, i AS place, regexp_extract(m, 'href="([^"]*)"', 1) AS href, NULLIF(trim(regexp_extract(m, '>([^<]*)</a>', 1)), '') AS name FROM (
  SELECT page_id, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS ms FROM pages)))"""


@add("src4_page_links", f"WITH {_LINKS} SELECT page_id, href, arg_min(name, place) FILTER (name IS NOT NULL) AS name FROM links GROUP BY page_id, href")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.page_links(io.table(spark, sf, "pages"), "page_id")


_RECORDS = r"""records AS (SELECT page_id, unnest(range(len(ms)))::INTEGER AS record, unnest(ms) AS raw FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ms FROM pages)),
  titled AS (SELECT page_id, record, trim(regexp_replace(raw, '<[^>]*>', ' ', 'g')) AS title, TRY_CAST(regexp_extract(raw, '\b((?:19|20)\d\d) \(\d+\)', 1) AS INTEGER) AS year FROM records)"""


@add("src5_page_records", f"WITH {_RECORDS} SELECT * FROM titled")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.page_records(io.table(spark, sf, "pages"), "page_id")


@add("src6_crawl", f"WITH {_RECORDS}, {_LINKS}, firsts AS (SELECT page_id, MIN(href) AS href FROM links GROUP BY page_id) SELECT split_part(url, '/', 4) AS \"group\", page_id, href, record, title FROM titled JOIN pages USING (page_id) LEFT JOIN firsts USING (page_id)")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.crawl(io.table(spark, sf, "pages"), "page_id", F.split_part("url", F.lit("/"), F.lit(4)))


@add("src7_json_histories", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.histories(io.table(spark, sf, "events").select("event_id", "props"), "props", "struct<k: bigint>").select("event_id", F.col("history.k").alias("k"))


@add("src8_optional_table", "SELECT c_custkey, c_name FROM customer")
def _(spark: Spark, sf: str) -> DataFrame:
    rejected = io.optional_table(spark, f"{sf}/rejected.parquet", "c_custkey long")
    return io.table(spark, sf, "customer").select("c_custkey", "c_name").join(rejected, "c_custkey", "left_anti")


@add("snk1_csv_sink", with_base() + "SELECT season, COUNT(*) AS n FROM panel GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    path = io.scratch_path(spark, "sink")
    io.write_csv(panel(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n")), path)
    return io.read_csv(spark, path, "season int, n long")


@add("snk2_json_summary", with_base() + f"SELECT COUNT(*) AS rows, COUNT(DISTINCT uid) AS entities, {r('AVG(CASE WHEN ppm IS NULL THEN 0 ELSE 1 END)')} AS covered FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    path = io.scratch_path(spark, "json")
    io.write_json(panel(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("uid").alias("entities"), rounded(F.avg(F.col("ppm").isNotNull().cast("double"))).alias("covered")), path)
    return spark.read.schema("rows long, entities long, covered double").json(path)


@add("snk3_latex_table", with_base("counted AS (SELECT season, COUNT(*) AS n FROM panel GROUP BY season)", "ranked AS (SELECT *, row_number() OVER (ORDER BY season) AS rn FROM counted)") + r"""SELECT CAST(line AS INTEGER) AS line, text FROM (
  SELECT 0 AS line, '\begin{tabular}{rr}' AS text UNION ALL SELECT 1, '\toprule' UNION ALL SELECT 2, 'season & n \\' UNION ALL SELECT 3, '\midrule' UNION ALL SELECT 3 + rn, season || ' & ' || n || ' \\' FROM ranked
  UNION ALL SELECT 4 + COUNT(*), '\bottomrule' FROM ranked UNION ALL SELECT 5 + COUNT(*), '\end{tabular}' FROM ranked)""")
def _(spark: Spark, sf: str) -> DataFrame:
    text = io.latex_table(panel(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n")).orderBy("season"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@add("snk4_plot_bars", with_base() + f"SELECT season, {r('AVG(n_clubs)')} AS height FROM panel GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.bars(panel(spark, sf), "season", rounded(F.avg("n_clubs")))


@add("snk4_plot_histogram", with_base() + 'SELECT CAST(floor(minutes / 25::DOUBLE) * 25 AS DOUBLE) AS "left", COUNT(*) AS n FROM panel GROUP BY 1')
def _(spark: Spark, sf: str) -> DataFrame:
    return io.histogram(panel(spark, sf), "minutes", 25.0).withColumn("left", F.col("left").cast("double"))


@add("snk4_plot_boxes", with_base() + "SELECT season, MIN(minutes) AS low, quantile_cont(minutes, 0.25) AS q1, quantile_cont(minutes, 0.5) AS median, quantile_cont(minutes, 0.75) AS q3, MAX(minutes) AS high FROM panel GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.boxes(panel(spark, sf), "season", "minutes")


@add("snk5_resume", "SELECT o_custkey AS uid, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders GROUP BY 1, 2 HAVING MAX(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 0")
def _(spark: Spark, sf: str) -> DataFrame:
    orders = io.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.year("o_orderdate").alias("season"), "o_orderstatus")
    path = io.scratch_path(spark, "checkpoint")
    orders.where("o_orderstatus = 'F'").select("uid", "season").distinct().write.parquet(path)
    return C.remaining_work(orders.select("uid", "season").distinct(), spark.read.schema("uid long, season int").parquet(path), ["uid", "season"])


@add("snk6_upsert", "SELECT c_custkey, c_acctbal, c_name FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 0::DOUBLE, NULL FROM customer WHERE c_acctbal < 0")
def _(spark: Spark, sf: str) -> DataFrame:
    old = io.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name")
    return C.upsert(old, old.where("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")), ["c_custkey"])


# -- projections -------------------------------------------------------------------------------------------------------------------


@add("prj1_rename", "SELECT l_orderkey AS game, l_quantity AS minutes, l_discount AS ppm FROM lineitem")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount").withColumnsRenamed({"l_orderkey": "game", "l_quantity": "minutes", "l_discount": "ppm"})


@add("prj2_number", "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS good, TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "orders").select("o_orderkey", P.number(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("good"), P.number("o_orderpriority").alias("bad"))


@add("prj3_rates", with_base() + f"SELECT uid, season, {', '.join(f'{r(c)} AS {c}' for c in ('npg_p90', 'sot_p90', 'tackles_p90'))} FROM vars")
def _(spark: Spark, sf: str) -> DataFrame:
    return variables(panel(spark, sf)).select("uid", "season", *[rounded(c).alias(c) for c in ("npg_p90", "sot_p90", "tackles_p90")])


@add("prj4_guarded_ratio", with_base() + f"SELECT uid, season, {r('CASE WHEN a > 0 THEN npg / a::DOUBLE WHEN a IS NOT NULL THEN 0 END')} AS x FROM (SELECT *, NULLIF(sot, 2) AS a FROM vars)")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).select("uid", "season", rounded(P.guarded_ratio(F.col("npg"), F.nullif("sot", F.lit(2)))).alias("x"))


@add("prj5_labels", with_base() + "SELECT uid, season, pos_F, pos_O, pos_P, CAST(pos = 'P' AS INTEGER) AS only_P FROM vars")
def _(spark: Spark, sf: str) -> DataFrame:
    return variables(panel(spark, sf)).select("uid", "season", "pos_F", "pos_O", "pos_P", (F.col("pos") == "P").cast("int").alias("only_P"))


@add("prj6_features", with_base() + f"SELECT uid, season, {r('n_clubs * n_clubs')} AS n_sq, {r('log_minutes')} AS log_minutes FROM vars")
def _(spark: Spark, sf: str) -> DataFrame:
    return variables(panel(spark, sf)).select("uid", "season", rounded(F.pow("n_clubs", F.lit(2))).alias("n_sq"), rounded("log_minutes").alias("log_minutes"))


@add("prj7_sentinel", "SELECT p_partkey, COALESCE(NULLIF(p_size, 7), -1) AS filled, NULLIF(COALESCE(NULLIF(p_size, 7), -1), -1) AS back FROM part")
def _(spark: Spark, sf: str) -> DataFrame:
    filled = F.coalesce(F.nullif("p_size", F.lit(7)), F.lit(-1))
    return io.table(spark, sf, "part").select("p_partkey", filled.alias("filled"), F.nullif(filled, F.lit(-1)).alias("back"))


@add("prj8_conditional", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS x FROM orders")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("x"))


@add("prj9_dictionary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS label, CAST(year(o_orderdate) - 1995 AS INTEGER) AS idx FROM orders")
def _(spark: Spark, sf: str) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return io.table(spark, sf, "orders").select("o_orderkey", F.try_element_at(names, "o_orderstatus").alias("label"), (F.year("o_orderdate") - 1995).alias("idx"))


@add("prj10_one_hot", with_base() + "SELECT uid, season, " + ", ".join(f"CAST(season = {y} AS INTEGER) AS s_{y}" for y in range(1996, 2002)) + " FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    return P.one_hot(panel(spark, sf).select("uid", "season"), "season", list(range(1995, 2002)), "s")


# -- filters -----------------------------------------------------------------------------------------------------------------------


@add("flt1_exposure", with_base() + "SELECT uid, season, minutes FROM sample")
def _(spark: Spark, sf: str) -> DataFrame:
    return sample(spark, sf).select("uid", "season", "minutes")


@add("flt2_pure_category", with_base() + "SELECT uid, season, pos FROM panel WHERE pos <> 'P'")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).where(~(F.col("pos") == "P")).select("uid", "season", "pos")


@add("flt3_impossible", with_base() + "SELECT uid, season, minutes FROM panel WHERE minutes <= 400")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).where(F.col("minutes") <= 400).select("uid", "season", "minutes")


@add("flt4_complete_rows", with_base() + "SELECT uid, season, ppm IS NOT NULL AS kept FROM vars")
def _(spark: Spark, sf: str) -> DataFrame:
    kept, dropped = P.complete_rows(variables(panel(spark, sf)), ["ppm", *SCALED])
    return kept.select("uid", "season", F.lit(True).alias("kept")).unionAll(dropped.select("uid", "season", F.lit(False)))


@add("flt5_drop_ambiguous", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.drop_ambiguous(io.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])[0]


@add("flt5_ambiguous_groups", "SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.drop_ambiguous(io.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])[1]


PAIRS = """pairs AS (SELECT a.uid, a.season, a.minutes AS minutes_t, b.minutes AS minutes_t1, a.value AS value_t, b.value AS value_t1, a.club_main AS club_main_t, b.club_main AS club_main_t1, a.n_clubs AS n_clubs_t
  FROM panel a JOIN panel b ON a.uid = b.uid AND b.season = a.season + 1)"""


def _pairs(spark: Spark, sf: str) -> DataFrame:
    return P.consecutive_pairs(panel(spark, sf), "uid", "season", ["minutes", "value", "club_main", "n_clubs"])


@add("flt6_variations", with_base(PAIRS) + " UNION ALL ".join(f"SELECT '{n}' AS variation, COUNT(*) AS n, COUNT(DISTINCT uid) AS entities FROM pairs WHERE {p}" for n, p in P.VARIATIONS.items()))
def _(spark: Spark, sf: str) -> DataFrame:
    marked = _pairs(spark, sf).select("uid", F.explode(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in P.VARIATIONS.items()])).alias("variation")).where("variation is not null")
    counted = marked.groupBy("variation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("entities"))
    every = spark.createDataFrame([(n,) for n in P.VARIATIONS], "variation string")
    return F.broadcast(every).join(counted, "variation", "left").na.fill(0, ["n", "entities"])


@add("flt6_winsorise", with_base() + f"SELECT uid, season, {r('least(greatest(value, lo), hi)', 4)} AS x FROM panel, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM panel)")
def _(spark: Spark, sf: str) -> DataFrame:
    return P.clip_between(panel(spark, sf), "value", 0.01, 0.99, "x").select("uid", "season", rounded("x", 4).alias("x"))


@add("flt7_near_constant", with_base() + "SELECT 'minutes' AS name UNION ALL SELECT 'shots' UNION ALL SELECT 'value'")
def _(spark: Spark, sf: str) -> DataFrame:
    df = panel(spark, sf).withColumn("one", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in P.near_constant(df, ["minutes", "one", "shots", "minutes", "value"])], "name string")


@add("flt8_periods", with_base() + "SELECT uid, season FROM panel WHERE season IN (1996, 1998)")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).where(F.col("season").isin(1996, 1998)).select("uid", "season")


@add("flt9_contains_all", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring')")
def _(spark: Spark, sf: str) -> DataFrame:
    has = lambda s: F.lower("p_name").contains(s.lower())
    return io.table(spark, sf, "part").where(has("RED") & has("Ring")).select("p_partkey", "p_name")


@add("aud1_funnel", with_base() + "SELECT 0 AS step, 'raw' AS name, COUNT(*) AS rows FROM raw UNION ALL SELECT 1, 'merged', COUNT(*) FROM panel UNION ALL SELECT 2, 'category', COUNT(*) FROM panel WHERE pos <> 'P' UNION ALL SELECT 3, 'exposed', COUNT(*) FROM sample WHERE pos <> 'P'")
def _(spark: Spark, sf: str) -> DataFrame:
    p = panel(spark, sf)
    kept = p.where("pos <> 'P'")
    return C.funnel([("raw", raw(spark, sf)), ("merged", p), ("category", kept), ("exposed", kept.where("minutes >= 50"))])


# -- joins -------------------------------------------------------------------------------------------------------------------------


@add("jn1_left_many_to_one", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark: Spark, sf: str) -> DataFrame:
    customers = io.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return C.checked_join(io.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"], "left", "m:1").select("o_orderkey", "c_name")


@add("jn2_inner_one_to_one", "SELECT c_custkey, c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def _(spark: Spark, sf: str) -> DataFrame:
    suppliers = io.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return C.checked_join(io.table(spark, sf, "customer").select("c_custkey", "c_name"), suppliers, ["c_custkey"], "inner", "1:1")


@add("jn3_consecutive", with_base(PAIRS) + "SELECT uid, season, minutes_t, minutes_t1, club_main_t, club_main_t1 FROM pairs")
def _(spark: Spark, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("uid", "season", "minutes_t", "minutes_t1", "club_main_t", "club_main_t1")


@add("jn4_two_eras", with_base(PAIRS) + "SELECT p.uid, p.season, a.pos AS pos_t, b.pos AS pos_t1 FROM pairs p JOIN panel a ON p.uid = a.uid AND p.season = a.season JOIN panel b ON p.uid = b.uid AND p.season + 1 = b.season")
def _(spark: Spark, sf: str) -> DataFrame:
    labels = panel(spark, sf).select(F.col("uid").alias("pid"), F.col("season").alias("at"), "pos")
    p = _pairs(spark, sf).select("uid", "season", F.col("uid").alias("pid_1"), (F.col("season") + 1).alias("next"))
    first = p.join(labels.withColumnRenamed("pos", "pos_t"), (F.col("uid") == F.col("pid")) & (F.col("season") == F.col("at"))).drop("pid", "at")
    return first.join(labels.withColumnRenamed("pos", "pos_t1"), (F.col("pid_1") == F.col("pid")) & (F.col("next") == F.col("at"))).select("uid", "season", "pos_t", "pos_t1")


@add("jn5_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey IS NOT DISTINCT FROM NULLIF(c_nationkey, 3)) AS hit FROM customer")
def _(spark: Spark, sf: str) -> DataFrame:
    left = io.table(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    right = io.table(spark, sf, "supplier").select("s_nationkey")
    same = F.col("k").eqNullSafe(F.col("s_nationkey"))
    return left.join(right, same, "left_semi").select("c_custkey", F.lit(True).alias("hit")).unionAll(left.join(right, same, "left_anti").select("c_custkey", F.lit(False)))


@add("jn6_nearest_date", """SELECT uid, season, o_orderkey, gap FROM (SELECT c.o_custkey AS uid, s.season, o.o_orderkey, CAST(abs(date_diff('day', make_date(s.season, 6, 1), CAST(o.o_orderdate AS DATE))) AS INTEGER) AS gap
  FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS season) s JOIN orders o ON o.o_custkey = c.o_custkey) WHERE gap <= 120
  QUALIFY row_number() OVER (PARTITION BY uid, season ORDER BY gap, o_orderkey) = 1""")
def _(spark: Spark, sf: str) -> DataFrame:
    orders = io.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), "o_orderkey", F.to_date("o_orderdate").alias("date"))
    target = F.explode(F.sequence(F.lit(1995), F.lit(2001)))
    targets = orders.select("uid").distinct().withColumn("season", target).withColumn("june", F.make_date("season", F.lit(6), F.lit(1)))
    return L.nearest_date(orders, targets, "uid", "date", "june", 120, [F.col("o_orderkey")]).select("uid", "season", "o_orderkey", "gap")


def _scores(pairs: str) -> str:
    """CTEs up to `scores` (a, b, by_sort, by_set): both ratios of pairs of texts, with longest common subsequences by dynamic programming, a row of the table a step."""
    sorted_ = lambda x: f"list_sort(list_filter(string_split({x}, ' '), lambda s: s <> ''))"
    only = lambda x, y: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda s: NOT list_contains({y}, s)))), ' ')"
    row = "list_transform(range(1, length(y) + 2), lambda j: greatest(row[j], COALESCE(list_max(list_transform(list_filter(range(1, j), lambda k: substr(y, k, 1) = substr(x, i + 1, 1)), lambda k: row[k] + 1)), 0)))"
    return f"""words AS (SELECT a, b, {sorted_('a')} AS wa, {sorted_('b')} AS wb FROM ({pairs})),
  split AS (SELECT *, array_to_string(wa, ' ') AS sa, array_to_string(wb, ' ') AS sb, array_to_string(list_sort(list_distinct(list_intersect(wa, wb))), ' ') AS common, {only('wa', 'wb')} AS oa, {only('wb', 'wa')} AS ob FROM words),
  forms AS (SELECT a, b, wa, wb, sa, sb, common, oa, ob, trim(common || ' ' || oa) AS ja, trim(common || ' ' || ob) AS jb FROM split),
  todo AS (SELECT sa AS x, sb AS y FROM forms UNION SELECT ja, jb FROM forms UNION SELECT common, ja FROM forms UNION SELECT common, jb FROM forms),
  dp AS (SELECT x, y, 0 AS i, list_transform(range(1, length(y) + 2), lambda j: CAST(0 AS BIGINT)) AS row FROM todo UNION ALL SELECT x, y, i + 1, {row} FROM dp WHERE i < length(x)),
  alike AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100::DOUBLE ELSE 200::DOUBLE * row[length(y) + 1] / (length(x) + length(y)) END AS ratio FROM dp WHERE i = length(x)),
  scores AS (SELECT f.a, f.b, s.ratio AS by_sort, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 WHEN common <> '' AND (oa = '' OR ob = '') THEN 100 WHEN common <> '' THEN greatest(j.ratio, p.ratio, q.ratio) ELSE j.ratio END AS by_set
    FROM forms f JOIN alike s ON s.x = sa AND s.y = sb JOIN alike j ON j.x = ja AND j.y = jb JOIN alike p ON p.x = common AND p.y = ja JOIN alike q ON q.x = common AND q.y = jb)"""


def _names(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    part = io.table(spark, sf, "part")
    left = part.where("p_type = 'ECONOMY'").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.nullif("p_size", F.lit(10)).alias("year"))
    right = part.where("p_type <> 'ECONOMY'").select("p_brand", F.col("p_partkey").alias("cand"), F.col("p_name").alias("cand_name"), F.nullif("p_size", F.lit(11)).alias("cand_year"))
    return left, right


_CANDIDATES = """cand AS (SELECT a.p_brand, a.p_partkey AS id, b.p_partkey AS cand, a.p_name AS name, b.p_name AS cand_name, CASE WHEN NULLIF(a.p_size, 10) IS NULL OR NULLIF(b.p_size, 11) IS NULL THEN 2 ELSE abs(a.p_size - b.p_size) END AS year_gap
  FROM part a JOIN part b USING (p_brand) WHERE a.p_type = 'ECONOMY' AND b.p_type <> 'ECONOMY' AND (NULLIF(a.p_size, 10) IS NULL OR NULLIF(b.p_size, 11) IS NULL OR abs(a.p_size - b.p_size) <= 1))"""


@add("jn7_blocked_fuzzy", f"""WITH RECURSIVE {_CANDIDATES}, {_scores("SELECT DISTINCT name AS a, cand_name AS b FROM cand")}
SELECT id, cand, {r('score')} AS score, CAST(year_gap AS INTEGER) AS year_gap FROM (SELECT c.*, greatest(by_sort, by_set - 5) AS score FROM cand c JOIN scores s ON s.a = c.name AND s.b = c.cand_name
  QUALIFY row_number() OVER (PARTITION BY id, p_brand ORDER BY score DESC, year_gap, cand) = 1) WHERE score >= CASE year_gap WHEN 0 THEN 70 WHEN 1 THEN 85 ELSE 92 END""")
def _(spark: Spark, sf: str) -> DataFrame:
    left, right = _names(spark, sf)
    return L.match_blocked(left, right, ["p_brand"], "id", "cand", "name", "cand_name", "year", "cand_year").select("id", "cand", rounded("score").alias("score"), "year_gap")


_BLOCKED = """blocked AS (SELECT a.p_brand AS brand, a.p_partkey AS id, b.p_partkey AS cand FROM part a JOIN part b USING (p_brand) WHERE a.p_type = 'ECONOMY' AND b.p_type <> 'ECONOMY'
  AND (NULLIF(a.p_size, 10) IS NULL OR NULLIF(b.p_size, 11) IS NULL OR abs(a.p_size - b.p_size) <= 1))"""


@add("jn7_blocking_step", f"WITH {_BLOCKED} SELECT id, COUNT(*) AS candidates, MIN(cand) AS first FROM blocked GROUP BY id")
def _(spark: Spark, sf: str) -> DataFrame:
    left, right = _names(spark, sf)
    return L.count_candidates(left, right, ["p_brand"], "id", "cand", "year", "cand_year")


@add("jn8_majority_vote", "SELECT o_custkey, o_orderpriority, n, best FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS best FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, best DESC, o_orderpriority) = 1")
def _(spark: Spark, sf: str) -> DataFrame:
    return L.majority_vote(io.table(spark, sf, "orders").withColumn("best", F.col("o_totalprice")), ["o_custkey"], "o_orderpriority", "best")


@add("jn9_weak_matches", "SELECT c_custkey, c_acctbal AS score, s.n FROM customer LEFT JOIN (SELECT NULLIF(s_nationkey, 3) AS k, COUNT(*) AS n FROM supplier GROUP BY 1) s ON NULLIF(c_nationkey, 3) IS NOT DISTINCT FROM s.k WHERE c_acctbal < 92")
def _(spark: Spark, sf: str) -> DataFrame:
    matches = io.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("score"), F.nullif("c_nationkey", F.lit(3)).alias("k"))
    reference = io.table(spark, sf, "supplier").groupBy(F.nullif("s_nationkey", F.lit(3)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return L.weak_matches(matches, reference, ["k"]).select("c_custkey", "score", "n")


@add("jn10_identities", f"""WITH RECURSIVE facts AS (SELECT p_brand AS ident, p_name AS key, MIN(p_size) AS year, MAX(p_retailprice) AS score, CAST(COUNT(*) AS DOUBLE) AS weight FROM part GROUP BY 1, 2),
  shared AS (SELECT * FROM facts QUALIFY COUNT(*) OVER (PARTITION BY ident) > 1),
  {_scores("SELECT DISTINCT x.key AS a, y.key AS b FROM shared x JOIN shared y USING (ident) WHERE x.key < y.key")},
  close AS (SELECT x.ident, MIN(by_set) AS alike FROM shared x JOIN shared y ON x.ident = y.ident AND x.key < y.key JOIN scores s ON s.a = x.key AND s.b = y.key GROUP BY x.ident),
  meet AS (SELECT ident, MAX(n) > 1 AS meets FROM (SELECT p_brand AS ident, p_type, COUNT(DISTINCT p_name) AS n FROM part GROUP BY 1, 2) GROUP BY ident),
  verdict AS (SELECT ident, NOT meets AND alike >= 90 AND span <= 1 AS same_person FROM close JOIN meet USING (ident) JOIN (SELECT ident, MAX(year) - MIN(year) AS span FROM shared GROUP BY ident) USING (ident))
SELECT ident, key, same_person, same_person OR row_number() OVER (PARTITION BY ident ORDER BY score DESC, weight DESC, key) = 1 AS keeps_ident FROM shared JOIN verdict USING (ident)""")
def _(spark: Spark, sf: str) -> DataFrame:
    rows = io.table(spark, sf, "part").select(F.col("p_brand").alias("ident"), F.col("p_name").alias("key"), F.col("p_type").alias("period"), F.col("p_name").alias("name"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("score"), F.lit(1.0).alias("w"))
    return L.resolve_identities(rows, "ident", "key", "period", "name", "year", "score", "w")


@add("jn11_fill_zero", "SELECT c_custkey, COALESCE(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey")
def _(spark: Spark, sf: str) -> DataFrame:
    n = io.table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return io.table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@add("jn12_compare_runs", with_base() + f"SELECT COUNT(*) AS rows, {r('MAX(ABS(a.minutes - b.m))')} AS most FROM panel a JOIN (SELECT uid, season, SUM(minutes) + 1 AS m FROM raw GROUP BY 1, 2) b USING (uid, season)")
def _(spark: Spark, sf: str) -> DataFrame:
    other = raw(spark, sf).groupBy("uid", "season").agg((F.sum("minutes") + 1).alias("minutes_b"))
    return panel(spark, sf).join(other, ["uid", "season"]).agg(F.count(F.lit(1)).alias("rows"), rounded(F.max(F.abs(F.col("minutes") - F.col("minutes_b")))).alias("most"))


@add("jn13_pairs_in_group", "SELECT a.n_regionkey AS region, a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark: Spark, sf: str) -> DataFrame:
    n = io.table(spark, sf, "nation")
    a, b = (n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias(x)) for x in "ij")
    return a.join(b, "region").where("i < j")


@add("jn14_exactly_one", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 = 2")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.exactly_one(io.table(spark, sf, "nation"), F.col("n_nationkey") % 5 == 2, ["n_nationkey"]).select("n_nationkey", "n_name")


# -- aggregates --------------------------------------------------------------------------------------------------------------------


@add("ag1_merge_sources", with_base() + f"SELECT uid, season, {', '.join(f'{r(c, 4)} AS {c}' for c in COUNTS)} FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).select("uid", "season", *[rounded(F.col(c).cast("double"), 4).alias(c) for c in COUNTS])


@add("ag2_main_source", with_base() + "SELECT uid, season, club_main FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).select("uid", "season", "club_main")


@add("ag3_distinct_sources", with_base() + "SELECT uid, season, n_clubs FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).select("uid", "season", "n_clubs")


@add("ag4_label_union", with_base() + "SELECT uid, season, pos FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).select("uid", "season", "pos")


@add("ag5_weighted_mean", with_base() + f"SELECT uid, season, {r('ppm')} AS ppm FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).select("uid", "season", rounded("ppm").alias("ppm"))


@add("ag6_shrink", with_base() + f"SELECT uid, season, {r('(npg + 10 * p) / (shots + 10)')} AS g_sh_shr FROM panel, (SELECT SUM(npg) / SUM(shots)::DOUBLE AS p FROM panel)")
def _(spark: Spark, sf: str) -> DataFrame:
    return P.shrink(panel(spark, sf), "npg", "shots", "g_sh_shr").select("uid", "season", rounded("g_sh_shr").alias("g_sh_shr"))


@add("ag7_scale_table", with_base() + " UNION ALL ".join(f"SELECT 'ALL' AS \"group\", '{c}' AS variable, {r(f'(SELECT median({c}) FROM sample)')} AS median, {r(f'a_{c}')} AS aad FROM scale" for c in SCALED))
def _(spark: Spark, sf: str) -> DataFrame:
    return P.scale_table(sample(spark, sf), SCALED).select("group", "variable", rounded("median").alias("median"), rounded("aad").alias("aad"))


@add("ag7_scaled_rows", with_base() + f"SELECT uid, season, {', '.join(f'{r(f's_{c}')} AS s_{c}' for c in SCALED)} FROM scaled")
def _(spark: Spark, sf: str) -> DataFrame:
    return scaled_sample(spark, sf).select("uid", "season", *[rounded(f"s_{c}").alias(f"s_{c}") for c in SCALED])


@add("ag8_coverage", with_base() + f"SELECT season, COUNT(*) AS rows, {r('AVG((ppm IS NOT NULL)::INTEGER)')} AS ppm_share FROM panel GROUP BY GROUPING SETS ((season), ())")
def _(spark: Spark, sf: str) -> DataFrame:
    return P.coverage(panel(spark, sf), "season", ["ppm"]).withColumn("ppm_share", rounded("ppm_share"))


@add("ag9_describe", with_base() + " UNION ALL ".join(f"SELECT '{c}' AS variable, COUNT({c}) AS n, {r(f'AVG({c})')} AS mean, {r(f'stddev_samp({c})')} AS sd, {r(f'MIN({c})')} AS min, {r(f'median({c})')} AS median, {r(f'MAX({c})')} AS max FROM vars" for c in ("minutes", "sot_rate", "ppm")))
def _(spark: Spark, sf: str) -> DataFrame:
    return P.describe(variables(panel(spark, sf)), ["minutes", "sot_rate", "ppm"]).select("variable", "n", *[rounded(c).alias(c) for c in ("mean", "sd", "min", "median", "max")])


@add("ag11_cross_tab", with_base() + "SELECT a.season, b.n_clubs, COUNT(p.uid) AS n, " + r("COUNT(p.uid) / SUM(COUNT(p.uid)) OVER (PARTITION BY a.season)") + " AS share FROM (SELECT DISTINCT season FROM panel) a CROSS JOIN (SELECT DISTINCT n_clubs FROM panel) b LEFT JOIN panel p ON p.season = a.season AND p.n_clubs = b.n_clubs GROUP BY a.season, b.n_clubs")
def _(spark: Spark, sf: str) -> DataFrame:
    counted = panel(spark, sf).groupBy("season", "n_clubs").agg(F.count(F.lit(1)).alias("n"))
    domain = counted.select("season").distinct().crossJoin(F.broadcast(counted.select("n_clubs").distinct()))  # few seasons, few counts
    full = domain.join(counted, ["season", "n_clubs"], "left").na.fill(0, ["n"])
    return full.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("season"))))


@add("ag12_pivot", with_base() + "SELECT season, " + ", ".join(f'CAST(SUM(CASE WHEN club_main = \'{c}\' THEN 1 END) AS BIGINT) AS "{c[:1]}"' for c in ("1-URGENT", "2-HIGH")) + " FROM panel GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).withColumn("c", F.substring("club_main", 1, 1)).groupBy("season").pivot("c", ["1", "2"]).agg(F.count(F.lit(1))).select("season", "1", "2")


@add("ag13_modal_share", with_base() + f"SELECT season, {r('MAX(n) / SUM(n)')} AS share FROM (SELECT season, club_main, COUNT(*) AS n FROM panel GROUP BY 1, 2) GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    counted = panel(spark, sf).groupBy("season", "club_main").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("season").agg(rounded(F.max("n") / F.sum("n")).alias("share"))


@add("ag14_grid_summary", with_base() + f"SELECT season, n_clubs, {r('AVG((minutes < 100)::INTEGER)')} AS share, {r('median(minutes)')} AS median FROM panel GROUP BY GROUPING SETS ((season), (n_clubs))")
def _(spark: Spark, sf: str) -> DataFrame:
    sets = panel(spark, sf).select("season", "n_clubs", "minutes").groupingSets([[F.col("season")], [F.col("n_clubs")]], F.col("season"), F.col("n_clubs"))
    return sets.agg(rounded(F.avg((F.col("minutes") < 100).cast("double"))).alias("share"), rounded(F.median("minutes")).alias("median"))


@add("ag15_quartiles", with_base() + f"SELECT n_clubs, {r('quantile_cont(value, 0.25)', 4)} AS q1, {r('quantile_cont(value, 0.5)', 4)} AS q2, {r('quantile_cont(value, 0.75)', 4)} AS q3, {r('MIN(value)', 4)} AS low, {r('MAX(value)', 4)} AS high, {r('AVG((value < 100000)::INTEGER)')} AS below FROM panel GROUP BY n_clubs")
def _(spark: Spark, sf: str) -> DataFrame:
    p = io.staged(panel(spark, sf).select("n_clubs", "value"), "panel")
    q = exact_quantiles(p, ["n_clubs"], "value", [0.25, 0.5, 0.75])
    out = p.groupBy("n_clubs").agg(rounded(F.min("value"), 4).alias("low"), rounded(F.max("value"), 4).alias("high"), rounded(F.avg((F.col("value") < 100000).cast("double"))).alias("below"))
    return out.join(q, "n_clubs").select("n_clubs", *[rounded(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)], "low", "high", "below")


@add("ag16_group_summary", with_base() + f"SELECT season, COUNT(*) AS n, {r('MIN(minutes)')} AS least, {r('AVG(minutes)')} AS mean, SUM((n_clubs > 1)::INTEGER)::BIGINT AS multi FROM panel GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    return panel(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n"), rounded(F.min("minutes")).alias("least"), rounded(F.avg("minutes")).alias("mean"), F.sum((F.col("n_clubs") > 1).cast("long")).alias("multi"))


@add("ag17_delta_distribution", with_base(PAIRS) + f"SELECT {r('AVG(d)')} AS mean, {r('stddev_samp(d)')} AS sd, {r('quantile_cont(d, 0.01)')} AS p1, {r('quantile_cont(d, 0.99)')} AS p99, {r('AVG((d = 0)::INTEGER)')} AS zero FROM (SELECT minutes_t1 - minutes_t AS d FROM pairs)")
def _(spark: Spark, sf: str) -> DataFrame:
    d = io.staged(_pairs(spark, sf).select((F.col("minutes_t1") - F.col("minutes_t")).alias("d")), "changes")
    ends = exact_quantiles(d, [], "d", [0.01, 0.99]).select(rounded(F.col("q")[0]).alias("p1"), rounded(F.col("q")[1]).alias("p99"))
    sums = d.agg(rounded(F.avg("d")).alias("mean"), rounded(F.stddev_samp("d")).alias("sd"), rounded(F.avg((F.col("d") == 0).cast("double"))).alias("zero"))
    return sums.crossJoin(ends)  # one row each


@add("ag18_string_sets", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS clubs FROM orders GROUP BY o_custkey")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("clubs"))


# -- windows -----------------------------------------------------------------------------------------------------------------------

_LEAD = "leads AS (SELECT uid, season, minutes, value, club_main, lead(season) OVER w AS s1, lead(value) OVER w AS v1, lead(club_main) OVER w AS c1 FROM panel WINDOW w AS (PARTITION BY uid ORDER BY season))"


@add("panel_pairs", with_base(_LEAD) + f"SELECT season, COUNT(*) AS pairs, {r('AVG(ln(v1) - ln(value))')} AS mean_delta FROM leads WHERE s1 = season + 1 AND minutes >= 50 GROUP BY season")
def _(spark: Spark, sf: str) -> DataFrame:
    """Flagship: merged panel, exposure filter, gap-aware lead, mean change by period."""
    led = P.gap_aware_lead(panel(spark, sf).select("uid", "season", "minutes", "value"), "uid", "season", ["value"])
    kept = led.where("has_next and minutes >= 50")
    return kept.groupBy("season").agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(F.log("value_next") - F.log("value"))).alias("mean_delta"))


@add("wn1_gap_aware_lead", with_base(_LEAD) + f"SELECT uid, season, CASE WHEN s1 = season + 1 THEN {r('v1', 4)} END AS value_next, COALESCE(s1 = season + 1, FALSE) AS has_next FROM leads")
def _(spark: Spark, sf: str) -> DataFrame:
    return P.gap_aware_lead(panel(spark, sf), "uid", "season", ["value"]).select("uid", "season", rounded("value_next", 4).alias("value_next"), "has_next")


@add("wn2_log_difference", with_base(_LEAD) + f"SELECT uid, season, CASE WHEN s1 = season + 1 THEN {r('ln(v1) - ln(value)')} END AS delta FROM leads")
def _(spark: Spark, sf: str) -> DataFrame:
    led = P.gap_aware_lead(panel(spark, sf), "uid", "season", ["value"])
    return led.select("uid", "season", rounded(F.log("value_next") - F.log("value")).alias("delta"))


@add("wn3_state_change", with_base(_LEAD) + "SELECT uid, season, CASE WHEN s1 = season + 1 THEN c1 <> club_main END AS changed FROM leads")
def _(spark: Spark, sf: str) -> DataFrame:
    led = P.gap_aware_lead(panel(spark, sf), "uid", "season", ["club_main"])
    return led.select("uid", "season", (F.col("club_main_next") != F.col("club_main")).alias("changed"))


@add("wn4_demean", with_base() + f"SELECT uid, season, {r('minutes - AVG(minutes) OVER (PARTITION BY uid)')} AS within, COUNT(*) OVER (PARTITION BY uid) AS size FROM panel")
def _(spark: Spark, sf: str) -> DataFrame:
    w = Window.partitionBy("uid")
    return panel(spark, sf).select("uid", "season", rounded(F.col("minutes") - F.avg("minutes").over(w)).alias("within"), F.count(F.lit(1)).over(w).alias("size"))


@add("wn5_total_movement", with_base() + f"SELECT uid, {r('SUM(ABS(d))')} AS moved FROM (SELECT uid, minutes - lag(minutes) OVER (PARTITION BY uid ORDER BY season) AS d FROM panel) GROUP BY uid")
def _(spark: Spark, sf: str) -> DataFrame:
    step = F.col("minutes") - F.lag("minutes").over(Window.partitionBy("uid").orderBy("season"))
    return panel(spark, sf).select("uid", step.alias("d")).groupBy("uid").agg(rounded(F.sum(F.abs("d"))).alias("moved"))


@add("wn6_keep_best", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.keep_best(io.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@add("wn7_distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


# -- order and sets ----------------------------------------------------------------------------------------------------------------


@add("tk1_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.top_n(io.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 5, [F.desc("o_totalprice"), F.col("o_orderkey")])


@add("tk2_sorted_head", with_base() + "SELECT uid, season, minutes FROM panel ORDER BY minutes, uid, season LIMIT 20")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.top_n(panel(spark, sf).select("uid", "season", "minutes"), 20, [F.col("minutes"), F.col("uid"), F.col("season")])


@add("tk3_priority_fill", "SELECT c_custkey, c_acctbal FROM customer ORDER BY (c_custkey IN (3, 5)) DESC, c_acctbal DESC, c_custkey LIMIT 8")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.fill_from_priority(io.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("c_custkey").isin(3, 5), [F.desc("c_acctbal"), F.col("c_custkey")], 8)


@add("so1_concat", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(spark: Spark, sf: str) -> DataFrame:
    a = io.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(io.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@add("so2_key_difference", "SELECT c_custkey AS uid FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark: Spark, sf: str) -> DataFrame:
    return C.key_difference(io.table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), io.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("uid")), ["uid"])


@add("so3_multiset_difference", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark: Spark, sf: str) -> DataFrame:
    lines = io.table(spark, sf, "lineitem")
    return C.multiset_difference(lines.where("l_returnflag = 'A'").select("l_partkey"), lines.where("l_returnflag = 'R'").select("l_partkey"))


# -- scalar functions --------------------------------------------------------------------------------------------------------------

_UNACCENT = "lower(title)"
for _a, _b in SPELLED.items():
    _UNACCENT = f"replace({_UNACCENT}, '{_a}', '{_b}')"
_UNACCENT = f"trim(regexp_replace(regexp_replace(translate({_UNACCENT}, '{MARKED}', '{BASE}'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@add("sc1_normalize_name", f"SELECT page_id, {_UNACCENT} AS name FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "pages").select("page_id", normalize_name(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("name"))


def _name_pairs(spark: Spark, sf: str) -> DataFrame:
    n = io.table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    return n.join(n.select(F.col("a").alias("b")), F.substring("a", 1, 1) == F.substring("b", 1, 1)).where("a < b")


_NAME_PAIRS = "SELECT x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x JOIN (SELECT DISTINCT p_name FROM part) y ON substr(x.p_name, 1, 1) = substr(y.p_name, 1, 1) WHERE x.p_name < y.p_name"


@add("sc2_token_sort_ratio", f"WITH RECURSIVE {_scores(_NAME_PAIRS)} SELECT a, b, {r('by_sort')} AS score FROM scores")
def _(spark: Spark, sf: str) -> DataFrame:
    return _name_pairs(spark, sf).withColumn("score", rounded(token_sort_ratio(F.col("a"), F.col("b"))))


@add("sc3_token_set_ratio", f"WITH RECURSIVE {_scores(_NAME_PAIRS)} SELECT a, b, {r('by_set')} AS score FROM scores")
def _(spark: Spark, sf: str) -> DataFrame:
    return _name_pairs(spark, sf).withColumn("score", rounded(token_set_ratio(F.col("a"), F.col("b"))))


@add("sc4_regex_extract", "SELECT p_partkey, CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS brand, regexp_replace(p_name, ' .*', '') AS colour FROM part")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("brand"), F.regexp_replace("p_name", " .*", "").alias("colour"))


@add("sc5_zero_pad", "SELECT o_orderkey, CASE WHEN length(s) >= 4 THEN s ELSE lpad(s, 4, '0') END AS code FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s FROM orders)")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "orders").select("o_orderkey", P.season_code(F.col("o_orderkey")).alias("code"))


@add("sc6_safe_date", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(spark: Spark, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("31/31/1999")
    return io.table(spark, sf, "orders").select("o_orderkey", F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date").alias("day"))


@add("sc7_season_label", "SELECT DISTINCT y || '/' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS label FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)")
def _(spark: Spark, sf: str) -> DataFrame:
    code = io.table(spark, sf, "orders").select(F.concat(F.substring(F.year("o_orderdate").cast("string"), 3, 2), F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0")).alias("c"), F.substring(F.year("o_orderdate").cast("string"), 1, 2).alias("century"))
    return code.select(F.concat("century", F.substring("c", 1, 2), F.lit("/"), F.substring("c", 3, 2)).alias("label")).distinct()


_SHARES = "shares AS (SELECT uid, season, npg / shots::DOUBLE AS a, (sot - npg) / shots::DOUBLE AS b, (shots - sot) / shots::DOUBLE AS c FROM panel)"
_CLIP = lambda x: f"least(greatest({x}, 1e-12::DOUBLE), 1) * ln(least(greatest({x}, 1e-12::DOUBLE), 1))"


def _shares(spark: Spark, sf: str) -> DataFrame:
    n = F.col("shots").cast("double")
    return panel(spark, sf).select("uid", "season", F.array(F.col("npg") / n, (F.col("sot") - F.col("npg")) / n, (F.col("shots") - F.col("sot")) / n).alias("u"))


@add("sc8_entropy", with_base(_SHARES) + f"SELECT uid, season, {r('-(' + ' + '.join(_CLIP(x) for x in 'abc') + ')')} AS h FROM shares")
def _(spark: Spark, sf: str) -> DataFrame:
    return _shares(spark, sf).select("uid", "season", rounded(V.entropy(F.col("u"))).alias("h"))


@add("sc9_norm", with_base(_SHARES) + f"SELECT uid, season, {r('sqrt((a-0.5)*(a-0.5) + (b-0.25)*(b-0.25) + (c-0.25)*(c-0.25))')} AS d FROM shares")
def _(spark: Spark, sf: str) -> DataFrame:
    centre = F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))
    return _shares(spark, sf).select("uid", "season", rounded(V.norm2(V.minus(F.col("u"), centre))).alias("d"))


@add("sc10_effect", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('100 * (exp(0.10 * l_discount) - 1)')} AS pct FROM lineitem")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rounded(V.percent_effect(F.col("l_discount"))).alias("pct"))


@add("sc11_clip", "SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 5), 40) AS q FROM lineitem")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.least(F.greatest("l_quantity", F.lit(5.0)), F.lit(40.0)).alias("q"))


@add("sc12_first_max", with_base(_SHARES) + "SELECT uid, season, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS top FROM shares")
def _(spark: Spark, sf: str) -> DataFrame:
    return _shares(spark, sf).select("uid", "season", V.first_max(F.col("u")).alias("top"))


@add("sc13_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark: Spark, sf: str) -> DataFrame:
    return io.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
