import math
import os
import random

import pytest

from caliperlake import registry
from caliperlake.operators import layout as L
from caliperlake.operators import ordered
from caliperlake.sources import adapters

DATA = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, page_index int, observation_id string, number int, x0 double, y0 double, x1 double, y1 double"


def boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(0, 300, 5), rng.randrange(0, 200, 5)
        out.append((1, i % 2, f"o{i:03}", i + 1, float(x), float(y), float(x + rng.choice([20, 21, 40])), float(y + 10)))
    return out


def iou(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    both = max(0, w) * max(0, h)
    return both / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - both)


def test_suppression_is_greedy_in_reading_order(spark):
    rows = boxes(160, 1)
    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[5], r[4], r[2])):
        if all(k[1] != r[1] or iou(k, r) < 0.8 for k in kept):
            kept.append(r)
    for given in (rows, rows[::-1]):
        assert {r.observation_id for r in L.suppressed(spark.createDataFrame(given, SCHEMA)).collect()} == {k[2] for k in kept}


def test_placement_keeps_every_item_and_flags_agree(spark):
    rows = boxes(60, 2)
    placed = L.placed_markers(spark.createDataFrame(rows, SCHEMA), 400.0, 300.0)
    got = placed.collect()
    assert {r.observation_id for r in got} == {r[2] for r in rows}
    assert sorted(map(str, L.placed_markers(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), 400.0, 300.0).collect())) == sorted(map(str, got))
    pairs = {(a.observation_id, b.observation_id) for a in got for b in got if a.page_index == b.page_index and a.observation_id < b.observation_id and math.dist((a.cx, a.cy), (b.cx, b.cy)) < 2 * L.RADIUS}
    assert {(r.left_id, r.right_id) for r in L.marker_overlaps(placed).collect()} == pairs
    for r in got:
        assert ("outside_cropbox" in r.flags) == (not (12 <= r.cx <= 388 and 12 <= r.cy <= 288))
        assert (r.status == "placed") == (r.flags == "")


def meets(a, b):
    return not (a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1])


def circle_meets(c, r, b):
    return math.hypot(c[0] - min(max(c[0], b[0]), b[2]), c[1] - min(max(c[1], b[1]), b[3])) < r


def reaches(p, q, b):
    if any(b[0] <= x <= b[2] and b[1] <= y <= b[3] for x, y in (p, q)):
        return True
    for axis in (0, 1):
        step = q[axis] - p[axis]
        for edge in (b[axis], b[axis + 2]):
            if step and 0 <= (t := (edge - p[axis]) / step) <= 1 and b[1 - axis] <= p[1 - axis] + t * (q[1 - axis] - p[1 - axis]) <= b[3 - axis]:
                return True
    return False


def crosses(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return not {p, q} & {r, s} and side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def brute_placement(rows, width, height, guarded=()):
    """Every candidate place against every text box, circle, number and leader of the page."""
    taken, out = [], {}
    rings, ways8 = (18, 30, 42, 56, 72, 90), [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    boxes = [(r.x0, r.y0, r.x1, r.y1) for r in rows]
    for r in sorted(rows, key=lambda r: (r.number, r.observation_id)):
        own = (r.x0, r.y0, r.x1, r.y1)
        target = ((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2)
        w, h = max(5.0, len(str(r.number)) * 0.636 * 9) / 2, 1.164 * 9 / 2
        ways = []
        for ring, reach in enumerate(rings):
            for d, (dx, dy) in enumerate(ways8):
                c = (target[0] + dx * reach, target[1] + dy * reach)
                g = (c[0] - w, c[1] - h, c[0] + w, c[1] + h)
                checks = (
                    ("outside_cropbox", not (12 <= c[0] <= width - 12 and 12 <= c[1] <= height - 12)), ("owner_glyph_outside_circle", math.hypot(w, h) > 11), ("unreadable_number", math.hypot(w, h) > 11),
                    ("protected_overlap", any(circle_meets(c, 12, b) or meets(g, b) for b in guarded)), ("source_text_overlap", any(circle_meets(c, 12, b) or meets(g, b) for b in boxes)), ("circle_overlap", any(math.dist(c, t) < 24 for t, _, _ in taken)), ("glyph_overlap", any(meets(g, o) for _, o, _ in taken)),
                    ("glyph_circle_overlap", any(circle_meets(t, 12, g) or circle_meets(c, 12, o) for t, o, _ in taken)),
                )
                flags = [n for n, bad in checks if bad]
                score = math.dist(c, target) + 20 * sum(reaches(c, target, b) for b in boxes if b != own) + 12 * sum(crosses(c, target, t, z) for t, _, z in taken) + 4 * sum(math.dist(c, t) < 60 for t, _, _ in taken)
                ways.append((len(flags), round(score, 9), ring, d, c, g, ",".join(flags)))
        best = min(ways)
        taken.append((best[4], best[5], target))
        out[r.observation_id] = (*best[4], best[6])
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_placement_query_places_every_marker_as_brute_force_does(spark):
    got = registry.QUERIES["win17_marker_placement"](spark, DATA).collect()
    given = ordered.numbered(adapters.observations(spark, DATA)).collect()
    assert len(got) == len(given)
    for page in [(1, 0), (2, 3)]:
        rows = [r for r in given if (r.doc_id, r.page_index) == page]
        assert len(rows) > 20
        assert {r.observation_id: (r.cx, r.cy, r.flags) for r in got if (r.doc_id, r.page_index) == page} == brute_placement(rows, 620.0, 620.0)


def test_placement_keeps_off_protected_boxes_as_brute_force_does(spark):
    rows, rng = boxes(70, 4), random.Random(6)
    guarded = [(1, rng.randrange(2), *(x := (float(rng.randrange(300)), float(rng.randrange(220)))), x[0] + 30, x[1] + 12) for _ in range(25)] + [(9, 9, 0.0, 0.0, 5.0, 5.0)]
    given, shut = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(guarded, "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    got = L.placed_markers(given, 400.0, 300.0, shut).collect()
    want = {}
    for page in (0, 1):
        want |= brute_placement([r for r in given.collect() if r.page_index == page], 400.0, 300.0, [g[2:] for g in guarded if g[:2] == (1, page)])
    assert {r.observation_id: (r.cx, r.cy, r.flags) for r in got} == want
    assert any("protected_overlap" in r.flags for r in got) or len(got) == len(rows)
    bare = {r.observation_id: (r.cx, r.cy) for r in L.placed_markers(given, 400.0, 300.0).collect()}
    assert bare != {k: v[:2] for k, v in want.items()}


def test_a_page_of_many_markers_takes_time_in_proportion(spark):
    import time

    import pyarrow as pa

    def seconds(n):
        side = int(n**0.5)
        k = range(n)
        page = pa.table({"doc_id": [1] * n, "page_index": [0] * n, "observation_id": [f"o{i:06}" for i in k], "number": list(range(1, n + 1)), "x0": [i % side * 45.0 for i in k], "y0": [i // side * 45.0 for i in k], "x1": [i % side * 45.0 + 20 for i in k], "y1": [i // side * 45.0 + 10 for i in k]})
        began = time.process_time()
        L._place(1e6, 1e6)(page)
        return time.process_time() - began

    seconds(100)
    assert seconds(4000) < 8 * seconds(1000)


def test_suppression_of_a_chain_of_shifted_boxes(spark):
    rows = [(1, 0, f"o{i:02}", i, float(i), 0.0, float(i + 20), 10.0) for i in range(12)]  # each overlaps the next two
    kept = []
    for r in rows:
        if all(iou(k, r) < 0.8 for k in kept):
            kept.append(r)
    assert {r.observation_id for r in L.suppressed(spark.createDataFrame(rows, SCHEMA)).collect()} == {k[2] for k in kept}
    assert L.suppressed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_candidate_markers_equal_brute_force(spark):
    rows = boxes(50, 3)
    got = {r.observation_id: (r.cx, r.cy) for r in L.candidate_markers(spark.createDataFrame(rows, SCHEMA), 400.0, 300.0).collect()}
    want = {}
    for page in (0, 1):
        mine, placed = sorted((r for r in rows if r[1] == page), key=lambda r: (r[3], r[2])), []
        for _, _, name, _, x0, y0, x1, y1 in mine:
            mx, my, ways = (x0 + x1) / 2, (y0 + y1) / 2, []
            for o in (12, 36):
                ways += [(x1 + o, y0 - o), (x1 + o, y1 + o), (x0 - o, y0 - o), (x0 - o, y1 + o), (x1 + o, my), (x0 - o, my), (mx, y0 - o), (mx, y1 + o)]
            ways = list(dict.fromkeys((min(max(x, 11), 389), min(max(y, 11), 289)) for x, y in ways))
            scored = []
            for i, c in enumerate(ways):
                leader = math.hypot(c[0] - min(max(c[0], x0), x1), c[1] - min(max(c[1], y0), y1)) or min(abs(c[0] - x0), abs(x1 - c[0]), abs(c[1] - y0), abs(y1 - c[1]))
                hits = sum(circle_meets(c, 12, r[4:]) for r in mine)
                scored.append((sum(math.dist(c, p) < 22 for p in placed) * 1e6 + hits * 500 + max(0, 15 - leader) * 1e4 + math.dist(c, ways[0]) * 10 + i, i))
            placed.append(ways[min(scored)[1]])
            want[name] = placed[-1]
    assert got == want
