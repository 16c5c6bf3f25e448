import random

from pyspark.sql import functions as F

from caliperlake.operators import ledger

SCHEMA = "mode string, page_index int, duration_ms long"


def test_percentiles_are_within_the_stated_error_and_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(3), int(rng.expovariate(1 / 400)) if rng.random() < 0.7 else 250) for _ in range(20_000)] + [("a", 0, None)]
    calls = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = ledger.latency_sketches(calls)
    found = ledger.sketch_errors(calls, whole).collect()
    assert len(found) == 3 * 4 and all(r.p50_within and r.p95_within for r in found)
    assert {r.calls for r in found if r["mode"] is None and r.page_index is None} == {20_000}
    # Sketches of two days, merged, are as good as one of both.
    days = [ledger.latency_sketches(calls.where(F.pmod(F.xxhash64("duration_ms", "mode"), F.lit(2)) == k)).where("mode is not null and page_index is not null") for k in range(2)]
    merged = ledger.merged_sketches(days[0].unionByName(days[1]).select("mode", "page_index", "calls", "sketch"))
    assert all(r.p50_within and r.p95_within for r in ledger.sketch_errors(calls, merged).collect())


def test_no_calls(spark):
    calls = spark.createDataFrame([], SCHEMA)
    assert ledger.sketch_errors(calls, ledger.latency_sketches(calls)).count() == 0
