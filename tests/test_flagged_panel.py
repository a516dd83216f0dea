"""The panel with flags in place of label sets agrees with the one that unites sets, and holds no set in any group."""

from pyspark.sql import functions as F

from cohortlab.operators import panel as P
from cohortlab.plans import base


def _tables(spark, at, statuses):
    rows = [(i, 1 + i % 3, f"199{5 + i % 2}-03-01", None if i % 7 == 6 else f"{1 + i % 5}-{'LOW' if i % 5 == 4 else 'X'}", s) for i, s in enumerate(statuses * 6)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_orderstatus string").withColumn("o_orderdate", F.col("o_orderdate").cast("date")).write.parquet(f"{at}/orders.parquet")
    lines = [(i, None if i % 11 == 10 else 20.0 + i, 3.0 * i, None if i % 4 == 3 else 0.01 * (i % 6), "RNA"[i % 3], "FO"[j]) for i in range(len(rows)) for j in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_agree_with_united_sets(spark, tmp_path):
    sf = _tables(spark, tmp_path, ["F", "O", None, "", "F,O", " P ", "FP", "F\n"])
    names = [*base.COUNTS, "club_main", "n_clubs", "ppm", "pos_F", "pos_O", "pos_P", "npg_p90", "sot_rate"]
    for sources in (True, False):
        own = [c for c in names if sources or c not in ("club_main", "n_clubs", "ppm")]
        rows = lambda df, own=own: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("uid", "season", *own).orderBy("uid", "season").collect()]
        assert rows(base.exposed(base.flagged_panel(spark, sf, sources))) == rows(base.sample(spark, sf))
    assert dict(base.flagged_panel(spark, sf).dtypes)["n_clubs"] == "bigint"


def test_no_sets_in_groups(spark, sf, monkeypatch):
    from cohortlab.plans import clustering

    seen = {}
    stage = lambda df, name: seen.setdefault(name, df) and spark.createDataFrame([], df.schema)
    monkeypatch.setattr(base, "staged", stage), monkeypatch.setattr(clustering, "staged", stage)
    clustering.both_rates(spark, sf)
    assert "collect_" not in _plan(seen.pop("sample"))
    base.cells(spark, sf, columns=["season", *base.TYPES.columns])
    assert "collect_" not in (plan := _plan(seen["sample"])) and " AS club" not in plan


def test_pooled_scales(spark):
    df = spark.createDataFrame([(float(i), 5.0, None if i % 2 else 1.0, None) for i in range(9)] + [(3.0, 6.0, 1.0, None)], "a double, b double, c double, d double")
    columns = df.columns
    want = {r["variable"]: r["aad"] for r in P.scale_table(df, columns).collect()}
    got = P.pooled_scales(df, columns)
    assert got.pop("d") is None and {c: round(x, 12) for c, x in got.items()} == {c: round(x, 12) for c, x in want.items()}
    assert P.add_scaled(df, columns).where("s_d is not null").isEmpty()
    assert P.add_scaled(df.limit(0), columns).isEmpty()
