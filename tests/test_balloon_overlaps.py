"""What balloons meet, worked out page by page, equals the joins of pairs."""

import random

from pyspark.sql import functions as F

from caliperlake.operators import balloons as B


def test_overlaps_equal_the_pairs(spark):
    r = random.Random(5)
    rows = [(r.choice((1, 2)), r.choice((0, 1)), f"b{k:03d}", r.choice((None, 0, 7, 45, 12345)), r.randrange(0, 200, 3) * 1.0, r.randrange(0, 200, 3) * 1.0) for k in range(120)]
    boxes = [(r.choice((1, 2, 3)), r.choice((0, 1)), f"t{k}", r.randrange(0, 220) * 1.0, r.randrange(0, 220) * 1.0, r.choice((0.0, 9.0, 40.0, 600.0))) for k in range(60)]
    live = spark.createDataFrame(rows, "doc_id long, page_index int, balloon_id string, formal_number int, cx double, cy double")
    found = spark.createDataFrame(boxes, "doc_id long, page_index int, box_id string, x0 double, y0 double, w double").select("*", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 6).alias("y1")).drop("w")
    texts, protected = found.where("box_id < 't3'"), found.where("box_id >= 't3'")
    df = B.with_overlaps(B.placed(live), texts, protected)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = df.collect()
    assert len(got) == len(rows)
    ids = lambda flag: {b.balloon_id for b in got if b[f"_{flag}"]}
    numbered = live.where("formal_number >= 1")
    for flag, some in (("text", texts), ("protected", protected)):
        want = {p.balloon_id for p in B.covered_boxes(numbered, some).collect()}
        assert want and ids(flag) == want
    pairs = B.collisions(numbered).collect()
    for flag in ("circle_overlap", "glyph_overlap", "glyph_circle_overlap"):
        want = {i for p in pairs if p[flag] for i in (p.left_id, p.right_id)}
        assert want and ids(flag) == want
