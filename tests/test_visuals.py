import math
import random

from caliperlake.operators import frames as F
from caliperlake.operators import requirements as R
from caliperlake.operators import routing
from caliperlake.operators import visuals as V


def fits(boxes, width, height):
    u = [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]
    pad = min(24, max(6, math.ceil(0.1 * max(u[2] - u[0], u[3] - u[1]))))
    c = (max(0, u[0] - pad), max(0, u[1] - pad), min(width, u[2] + pad), min(height, u[3] + pad))
    w, h = c[2] - c[0], c[3] - c[1]
    return c if w * h <= width * height * 0.075 and math.ceil(w * 300 / 72) <= 1536 and math.ceil(h * 300 / 72) <= 1536 and len(boxes) <= 32 else None


def test_crops_are_packed_first_fit(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        x, y = rng.uniform(0, 560), rng.uniform(0, 860)
        rows.append((1, i % 2, f"v{i:03}", i % 3, x, y, x + (450.0 if i == 7 else 30.0), y + 20))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, visual_id string, priority int, x0 double, y0 double, x1 double, y1 double")
    got = {r.visual_id: (r.page_index, r.crop, r.x0) for r in V.packed_crops(df.repartition(3), 600.0, 900.0).collect()}
    assert len(got) == len(rows)
    for page in (0, 1):
        crops: list[list] = []
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: (r[3], r[5], r[4], r[2])):
            home = next((c for c in crops if fits([b[4:] for b in c] + [r[4:]], 600, 900)), None)
            if home is None:
                crops.append([r])
            else:
                home.append(r)
        for k, members in enumerate(crops):
            c = fits([b[4:] for b in members], 600, 900)
            assert all(got[m[2]] == (page, k, c and c[0]) for m in members)
    assert got["v007"][2] is None  # wider than a crop may be


def packed_by_trying_all(rows, width, height):
    crops = []
    for r in rows:
        home = next((c for c in crops if fits([b[4:] for b in c] + [r[4:]], width, height)), None)
        if home is None:
            crops.append([r])
        else:
            home.append(r)
    return {m[2]: (k, (fits([b[4:] for b in c], width, height) or (None,) * 4)) for k, c in enumerate(crops) for m in c}


def test_the_index_of_crops_finds_what_trying_all_of_them_finds():
    """Pages of any shape, small and large visuals, points, boxes over the edges, more equal boxes than a crop takes."""
    from collections import namedtuple

    row = namedtuple("Row", "doc_id page_index visual_id priority x0 y0 x1 y1")
    rng = random.Random(9)
    for width, height, n in ((600.0, 900.0, 400), (90.0, 5000.0, 300), (5000.0, 3000.0, 300), (40.0, 40.0, 60)):
        rows = []
        for i in range(n):
            w, h = rng.choice([(0.0, 0.0), (4.0, 9.0), (width * 0.2, height * 0.2), (width * 0.27, height * 0.26), (width * 0.6, 3.0)])
            x, y = rng.uniform(-w / 2, width), rng.uniform(-h / 2, height)
            rows.append(row(1, 0, f"v{i:04}", 0, x, y, x + w * rng.uniform(0.5, 1), y + h))
        rows += [row(1, 0, f"w{i:04}", 0, 5.0, 5.0, 9.0, 9.0) for i in range(70)]
        if width == 600.0:
            rows.sort(key=lambda r: r.y0)
        want = packed_by_trying_all(rows, width, height)
        assert {v: (k, tuple(c)) for _, _, v, k, *c in V._packer(width, height)(rows)} == want


def test_crops_of_broken_boxes_and_of_a_page_with_many_visuals():
    import time
    from collections import namedtuple

    row = namedtuple("Row", "doc_id page_index visual_id priority x0 y0 x1 y1")
    broken = [row(1, 0, "a", 0, None, 0.0, 1.0, 1.0), row(1, 0, "b", 0, math.nan, 0.0, 1.0, 1.0), row(1, 0, "c", 0, 9.0, 0.0, 1.0, 1.0), row(1, 0, "d", 0, 700.0, 0.0, 800.0, 1.0), row(1, 0, "e", 0, 1.0, 1.0, 2.0, 2.0)]
    got = {r[2]: r[3:] for r in V._packer(600.0, 900.0)(broken)}
    assert [got[v][0] for v in "abcde"] == [0, 1, 2, 3, 4] and all(got[v][1] is None for v in "abcd") and got["e"][1:] == (0.0, 0.0, 8.0, 8.0)
    rng = random.Random(1)
    points = [(rng.uniform(0, 590), rng.uniform(0, 890)) for _ in range(100_000)]
    begin = time.monotonic()
    out = V._packer(600.0, 900.0)([row(1, 0, f"v{i}", 0, x, y, x + 6, y + 6) for i, (x, y) in enumerate(points)])
    assert len(out) == 100_000 and time.monotonic() - begin < 30


def test_segments_of_one_line_are_joined_and_averaged(spark):
    rows = [(1, 0, "horizontal", 10.0, 0.0, 5.0), (1, 0, "horizontal", 10.125, 6.0, 9.0), (1, 0, "horizontal", 10.125, 11.0, 12.0), (1, 0, "vertical", 10.0, 0.0, 5.0), (2, 0, "horizontal", 10.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, orientation string, coordinate double, start double, end double")
    got = sorted(map(tuple, F.joined_segments(df).collect()))
    assert got == [(1, 0, "horizontal", 10.0625, 0.0, 9.0), (1, 0, "horizontal", 10.125, 11.0, 12.0), (1, 0, "vertical", 10.0, 0.0, 5.0), (2, 0, "horizontal", 10.0, 0.0, 5.0)]


def test_entries_of_empty_tables_and_blank_texts(spark):
    schema = "doc_id long, page_index int, observation_id string, raw_text string, x0 double, y0 double, x1 double, y1 double, dx double, dy double, place int"
    rows = [(1, 0, "a", "技术要求：\n1. 表面abc\ndef\n\n2、xyz", 0.0, 0.0, 60.0, 60.0, 1.0, 0.0, 0), (1, 0, "b", " \n ", 0.0, 61.0, 60.0, 70.0, 1.0, 0.0, 1), (2, 0, "c", "检查外观，不得有裂纹", 0.0, 0.0, 9.0, 9.0, 1.0, 0.0, 0)]
    got = [(r.doc_id, r.ordinal, r.raw_text, r.n_segments) for r in R.entries(spark.createDataFrame(rows, schema)).orderBy("doc_id", "entry").collect()]
    assert got == [(1, 1, "表面abc def", 2), (1, 2, "xyz", 1), (2, None, "检查外观，不得有裂纹", 1)]
    assert R.entries(spark.createDataFrame(rows, schema).limit(0)).count() == 0


def test_cycles_of_a_square_with_a_diagonal(spark):
    ends = [(0, 0, 10, 0), (10, 0.25, 10, 10), (10.25, 10, 0, 10), (0, 10, 0, 0.25), (0, 0, 10, 10), (5, 5, 5.25, 5)]
    rows = [(1, 1, i, *map(float, e)) for i, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "doc_id long, drawing_id long, place int, ax double, ay double, bx double, by double")
    r = routing.cycles(routing.clustered_edges(df)).first()
    assert (r.triangles, r.squares) == (2, 1)


def test_items_near_texts_are_those_that_trying_all_finds(spark):
    """Pages of any shape: boxes that touch, equal texts and items, small and wide items, edges beyond the page, rows without a place; no pair is a row of a table."""
    import hashlib

    rng = random.Random(12)
    at = lambda: rng.choice([float(rng.randrange(-40, 400)), rng.uniform(0, 400), 12.0])
    texts, items = [], []
    for k in range(120):
        x, y = at(), at()
        texts += [(1, k % 3, f"t{k}", rng.choice(["A1", "Text", None]), x, y, x + 20, y + 10)] * rng.choice([1, 1, 2])
        x, y = at(), at()
        items += [(1, k % 3, f"c{k:03}", rng.choice([True, False, None]), x, y, x + rng.choice([3.0, 40.0, 80.0, 97.0]), y + rng.choice([1.5, 20.0, 50.0]))] * rng.choice([1, 1, 2])
    texts.append((1, 0, "lost", "A", None, 0.0, 1.0, 1.0))
    items.append((1, None, "lost", True, 0.0, 0.0, 1.0, 1.0))
    want = {}
    for t in set(texts[:-1]):
        near = [i for i in items[:-1] if i[1] == t[1] and i[6] - i[4] <= 96 and i[7] - i[5] <= 96 and i[4] <= t[6] + 12 and t[4] - 12 <= i[6] and i[5] <= t[7] + 12 and t[5] - 12 <= i[7]] * texts.count(t)
        if near:
            near.sort(key=lambda i: (i[5], i[4], i[7], i[6], i[2]))
            want[t[2]] = (len(near), min(t[4], *(i[4] for i in near)), hashlib.sha256("".join(i[2] for i in near).encode()).hexdigest())
    t = spark.createDataFrame(texts, "doc_id long, page_index int, observation_id string, raw_text string, x0 double, y0 double, x1 double, y1 double")
    i = spark.createDataFrame(items, "doc_id long, page_index int, content string, fill boolean, x0 double, y0 double, x1 double, y1 double")
    found = V.proposals(t.repartition(3), i.repartition(2), 1e6, 1e6)
    rows = found.collect()
    assert len(rows) > 20 and len({r.text_id for r in rows}) == len(rows)
    assert all((r.n_items, r.x0, r.geometry_sha256) == (want[r.text_id][0], max(0.0, want[r.text_id][1]), want[r.text_id][2]) for r in rows if not r.replaced)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
