import zlib

import corpus_pipeline
from cohortlab.llm import quality, queries


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, sf)
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name.replace(' ', '')}"
        out.write.parquet(path)
        step = spark.read.parquet(path)
    assert 0 < step.count() < docs.count()
    left = {r["doc_id"] for r in step.collect()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == left
    assert all("token = " not in r["text"] or "[SECRET]" in r["text"] for r in step.collect())
    # brute force: classifier, then equal texts (largest id), then near copies (least id)
    from .test_dedup import brute_classes

    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = [(r["doc_id"], r["text"]) for r in quality.score(docs, model).where("predicted = 1").collect()]
    last = {}
    for i, t in good:
        last[t] = max(i, last.get(t, i))
    classes = brute_classes([(i, t) for t, i in last.items()])
    assert left == set(classes.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "secret scans", "best-fit packing"]


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)} and set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names) and zlib.crc32(b"1") >= 0


def test_queries_against_sql(spark):
    from tests.oracle import connect, difference

    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    for name, sql in queries.ORACLE_SQL.items():
        assert difference(spark, con, queries.QUERIES[name], sql, sf) == ""
