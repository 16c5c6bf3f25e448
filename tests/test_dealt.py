"""Small tables are dealt to tasks before rows are exploded from them."""

import os

import pytest
from pyspark.sql import functions as F

from caliperlake.operators import reports, routing
from caliperlake.plans import profiles
from caliperlake.sources import adapters as S

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_form_pages_are_exploded_in_many_tasks(spark):
    customers = S.table(spark, DATA, "customer").count()
    pages, segments, texts = profiles._tables(spark, DATA)
    for made in (pages, segments, texts):
        by_task = made.groupBy(F.spark_partition_id()).count().collect()
        assert len(by_task) == 4
    assert pages.count() == customers == pages.select("doc_id").distinct().count()


def test_rows_of_rare_texts_are_not_copied(spark, monkeypatch):
    rows = [(1, "a", k % 3, f"a{k:03}") for k in range(90)] + [(d, t, k, f"{t}{k}") for d in (1, 2) for t in "bcd" for k in range(3)] + [(2, None, 0, "n0"), (2, None, 1, "n1")]
    want = sorted((d, i, j) for d, t, v, i in rows for e, u, w, j in rows if d == e and t and t == u and v != w and i < j)
    df = spark.createDataFrame(rows, "doc_id long, t string, v int, id string")
    for many, copied in ((4096, False), (16, True)):
        monkeypatch.setattr(reports, "MANY", many)
        found = reports.cross_view_duplicates(df, "t", "v", "id")
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 7" not in plan and "parts" in plan


def test_pairs_of_visuals_and_candidates_are_never_dealt(spark):
    v = spark.createDataFrame([(1, "v1", [3, 1, 3]), (1, "v2", [2, None]), (1, "v3", [9])], "doc_id long, visual_id string, text_ids array<long>")
    c = spark.createDataFrame([(1, "c1", [1, 3], 0.0), (1, "c2", [2, None], 0.0), (1, "c3", [3, 1, 1], 0.0), (1, "c4", [3], 5.0)], "doc_id long, candidate_id string, source_ids array<long>, x0 double").selectExpr("*", "0D AS y0", "5D AS x1", "1D AS y1")
    t = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0)], "doc_id long, source_id long, x0 double").selectExpr("*", "0D AS y0", "5D AS x1", "1D AS y1")
    found = routing.overlapping_sources(v, c, t)
    assert sorted(map(tuple, found.collect())) == [(1, "v1", "c1", True, True), (1, "v1", "c3", False, True), (1, "v1", "c4", False, False), (1, "v2", "c2", False, False)]
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("visual_id" in line for line in dealt)
