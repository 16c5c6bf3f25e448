import random

import pytest
from pyspark.sql import functions as F

from caliperlake.operators import logs
from caliperlake.streaming import replays

SCHEMA, KEYS = "doc_id long, attempt long, body string", ["doc_id", "attempt"]


def events():
    rng = random.Random(9)
    rows = [(d, a, f"body {d} {a}") for d in range(10) for a in range(12)]
    rows += rng.sample(rows, 40) + [(d, a, "another body") for d, a, _ in rng.sample(rows, 9)] + [(3, 4, "a third body"), (None, 1, "x"), (1, None, "x"), (5, 5, None)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((r.doc_id, r.attempt, r.n_rows, r.kinds, r.conflict) for r in df.collect())


@pytest.mark.parametrize(("pieces", "killed"), [(1, None), (5, None), (5, "accepted"), (4, "replays")])
def test_the_log_is_the_batch_result_in_any_order_and_after_a_killed_batch(spark, tmp_path, monkeypatch, pieces, killed):
    rows = [r for r in events() if r[2] is not None]
    want = result(logs.replay_check(spark.createDataFrame(rows, SCHEMA).where("doc_id is not null and attempt is not null"), KEYS, F.col("body")))
    source, log = tmp_path / "in", str(tmp_path / "log")
    for k in range(pieces):
        spark.createDataFrame(rows[k::pieces], SCHEMA).coalesce(1).write.parquet(str(source / f"p={k}"))
    stream = spark.readStream.schema(SCHEMA + ", p int").option("maxFilesPerTrigger", 1).parquet(str(source))
    append = replays.append_once(log, KEYS, F.col("body"), buckets=4)
    left = [killed]

    def batch(df, number):
        if left[0] and number == 2:  # dies after it wrote some of its parts
            parts = replays.PARTS
            monkeypatch.setattr(replays, "PARTS", parts[parts.index(left[0]) :])
            left[0] = None
            try:
                append(df, number)
            finally:
                monkeypatch.setattr(replays, "PARTS", parts)
            raise RuntimeError("killed")
        append(df, number)

    for _ in range(2 if killed else 1):
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(batch).start()
        try:
            q.awaitTermination(200)
        except Exception as e:
            assert "killed" in str(e)
    assert result(replays.replay_result(spark, log, "doc_id bigint, attempt bigint")) == want
    accepted = spark.read.parquet(f"{log}/accepted")
    assert accepted.count() == accepted.select(*KEYS).distinct().count() == len(want)
    assert {(r.row.doc_id, r.row.attempt) for r in accepted.collect()} == {w[:2] for w in want}


def test_only_touched_buckets_are_read(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    append = replays.append_once(log, ["k"], F.col("v"), buckets=16)
    append(spark.range(200).selectExpr("id AS k", "'a' AS v"), 0)
    seen, real = [], replays.stored
    monkeypatch.setattr(replays, "stored", lambda *a: seen.append(real(*a)) or seen[-1])
    append(spark.createDataFrame([(7, "a"), (7, "b")], "k long, v string"), 1)
    bucket = spark.createDataFrame([(7,)], "k long").select(F.pmod(F.xxhash64("k"), F.lit(16)).cast("int")).first()[0]
    plan = seen[0].where(F.col("bucket").isin([bucket]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "PartitionFilters" in plan
    assert result_of(replays.replay_result(spark, log, "k bigint").where("k = 7")) == [(7, 3, 2, True)]


def result_of(df):
    return [tuple(r) for r in df.collect()]
