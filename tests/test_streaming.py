from conflux.operators.admission import final_incumbents
from conflux.streaming import admission

SCHEMA = "run long, t long, id long, value double, deadline long"


def test_stream_reproduces_the_batch_result(spark, tmp_path):
    rows = [(i % 7, (i * 37) % 100, i, float((i * 13) % 29), 60 + i % 7) for i in range(200)]
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[2] % 4 == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest = {}

    def keep(batch, _):
        latest.update({r.run: tuple(r) for r in batch.collect()})

    q = admission.streaming_incumbents(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = {r.run: tuple(r) for r in final_incumbents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert latest == want


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    batches = [[(1, 5.0), (2, 1.0)], [(1, 7.0), (3, 2.0)], [(2, 9.0)]]
    for epoch in (0, 1, 1, 2, 2):
        admission.upsert_latest(spark.createDataFrame(batches[epoch], "run long, delivered double"), epoch, path)
    want = [(1, 7.0), (2, 9.0), (3, 2.0)]
    assert sorted(tuple(r) for r in admission.latest(spark, path).collect()) == want
    other = str(tmp_path / "other")
    assert admission.compacted(spark, path, other) == 2
    assert sorted(tuple(r) for r in admission.latest(spark, other).collect()) == want


def test_spent_keys_are_forgotten_with_the_watermark(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = "run long, action long, cap int, workpoint string, at timestamp"
    for k, day in enumerate((1, 2, 9)):
        rows = [(1, a, 16, "short", None) for a in (0, 0, k)]
        spark.createDataFrame(rows, schema).withColumn("at", F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = admission.spent_requests(stream, "at", "2 days").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(180)
    assert q.exception() is None
    got = sorted((r.action, r["at"].day) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1), (0, 9), (1, 2), (2, 9)] or got == [(0, 1), (1, 2), (2, 9)]
    assert q.lastProgress is None or sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 3
