"""Markers of many pages are placed in one step; long pages and pages between others come out the same."""

import random

import pytest
from pyspark.sql import functions as F

from caliperlake.operators import layout as L

SCHEMA = "doc_id long, page_index int, observation_id string, number int, x0 double, y0 double, x1 double, y1 double"


def rows_of(pages, seed=3):
    r = random.Random(seed)
    out = []
    for doc, n in pages:
        for k in range(n):
            x, y = r.randrange(0, 380, 5) * 1.0, r.randrange(0, 280, 5) * 1.0
            out.append((doc, 0, f"{doc}-{k:03d}", k + 1 if k % 7 else k, x, y, x + r.choice((8.0, 20.0, 150.0)), y + 8.0))
    return out


@pytest.mark.parametrize("place", [L.placed_markers, L.candidate_markers])
def test_steps_over_pages_and_long_pages_equal_one_page_at_a_time(spark, monkeypatch, place):
    rows = rows_of(((1, 90), (2, 1), (3, 40), (5, 60)))
    given = spark.createDataFrame(rows, SCHEMA)
    together = set(place(given, 400.0, 300.0).collect())
    alone = set()
    for doc in (1, 2, 3, 5):
        alone |= set(place(given.where(F.col("doc_id") == doc), 400.0, 300.0).collect())
    assert together == alone and len(together) == len(rows)
    monkeypatch.setattr(L, "_LONG", 20)  # markers after the twentieth look into the grid
    monkeypatch.setattr(L, "_PAIRS", 64)  # and pairs come in small steps
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(L)  # so that the workers see these values
    try:
        assert set(place(given, 400.0, 300.0).collect()) == together
    finally:
        cloudpickle.unregister_pickle_by_value(L)


def test_pages_share_a_python_step(spark):
    """Pages stream through sorted partitions instead of one call each."""
    given = spark.createDataFrame(rows_of(((1, 3), (2, 3))), SCHEMA)
    for df in (L.placed_markers(given, 400.0, 300.0, given), L.candidate_markers(given, 400.0, 300.0)):
        assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.placed_markers(none, 400.0, 300.0).collect() == [] == L.candidate_markers(none, 400.0, 300.0).collect()
