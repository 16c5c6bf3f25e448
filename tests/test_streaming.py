from pyspark.sql import functions as F

from caliperlake.streaming import logs


def run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_running_ledger(spark, tmp_path):
    rows = [(1, 0, 10), (1, 0, 20), (1, 1, 5), (2, 0, 7)]
    out = run(logs.running_ledger(source(spark, tmp_path, rows, "doc_id long, page_index int, duration_ms long")), "complete", "ledger", spark)
    assert {(r.doc_id, r.page_index, r.calls, r.total_ms) for r in out.collect()} == {(1, 0, 2, 30), (1, 1, 1, 5), (2, 0, 1, 7)}


def test_replays_are_dropped(spark, tmp_path):
    rows = [("a", "x", "2024-01-01 00:00:00"), ("a", "x", "2024-01-01 00:01:00"), ("a", "y", "2024-01-01 00:02:00")]
    events = source(spark, tmp_path, rows, "k string, h string, t string").withColumn("ts", F.to_timestamp("t"))
    out = run(logs.without_replays(events, ["k", "h"], "ts"), "append", "replays", spark)
    assert {(r.k, r.h) for r in out.collect()} == {("a", "x"), ("a", "y")} and out.count() == 2


def test_preview_heads(spark, tmp_path):
    rows = [(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")]
    out = run(logs.preview_heads(source(spark, tmp_path, rows, "doc_id long, revision int, content string")), "complete", "heads", spark)
    assert {(r.doc_id, r.revision, r.content) for r in out.collect()} == {(1, 3, "c"), (2, 1, "z")}
