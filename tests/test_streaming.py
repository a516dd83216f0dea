from pyspark.sql import functions as F

from cohortlab.streaming import incremental


def test_windowed_counts_match_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events")
    query = incremental.windowed_counts(stream, "ts", ["event_type"], "value").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/a").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    got = spark.table("windows").select("start", "event_type", "n")
    assert got.count() == batch.count() and got.exceptAll(batch).isEmpty()


def test_upsert_stream(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    run = lambda: incremental.upsert_stream(spark.readStream.schema("k int, v string").parquet(source), out, ["k"], f"file://{tmp_path}/c", [F.desc("v")]).awaitTermination(120)
    add = lambda *rows: spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(source)
    read = lambda: sorted(map(tuple, incremental.upserted(spark, out).collect()))
    assert incremental.upserted(spark, out) is None
    add((1, "a"), (2, "b"), (2, "a"))  # of one key the first in order counts
    run()
    assert read() == [(1, "a"), (2, "b")]
    add((2, "c"), (3, "d"))
    run()
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    # a batch dies between its files and the commit: the table before stays in force, and the repetition completes it
    versions, checkpoint = tmp_path / "out" / "versions", tmp_path / "c"
    last = sorted(versions.iterdir())[-1]
    (last / "_SUCCESS").unlink()
    for part in list(last.glob("part-*"))[:1]:
        part.unlink()
    assert read() == [(1, "a"), (2, "b")]
    number = int(last.name[1:])
    for name in (f"{number}", f".{number}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    run()
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    for i in range(4):
        add((9, str(i)))
        run()
    assert read()[-1] == (9, "3") and len(list(versions.iterdir())) == 3
