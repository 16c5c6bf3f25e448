import random

import pandas as pd

from caliperlake.operators import frames as R
from caliperlake.plans import frames as plans


def brute(rows):
    runs = []
    for *key, c, s, e in rows:
        last = runs[-1] if runs else None
        if last and last[:3] == key and abs(last[3] - c) <= R.AXIS and s <= last[5] + R.GAP:
            last[3:] = [(last[3] + c) / 2.0, min(last[4], s), max(last[5], e)]
        else:
            runs.append([*key, c, s, e])
    return runs


def test_runs_go_on_over_batches_and_end_with_their_page():
    rng = random.Random(3)
    rows = sorted([d, p, o, rng.randrange(40) / 8, float(s := rng.randrange(30)), s + rng.randrange(1, 4) * 1.0] for d in range(3) for p in range(2) for o in ("horizontal", "vertical") for _ in range(50))
    names = ["doc_id", "page_index", "orientation", "coordinate", "start", "end"]
    for size in (1, 7, 1000):
        batches = (pd.DataFrame(rows[k : k + size], columns=names) for k in range(0, len(rows), size))
        assert [list(r) for pdf in R._runs(batches) for r in pdf.itertuples(index=False)] == brute(rows)
    assert list(R._runs(iter([pd.DataFrame(columns=names)]))) == []


def test_segments_are_joined_once_for_all_that_reads_them(spark):
    for query in (plans.grp05_join26_tolerance_frames, plans.join04_frame_texts, plans.join36_frames_outside_administration):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan


def test_runs_of_near_coordinates_and_long_lines(spark):
    rng = random.Random(7)
    rows = sorted([d, 0, o, float(rng.randrange(9)) + rng.choice((0, 0, 0, 0.125)), float(s := rng.randrange(300)), s + float(rng.randrange(9))] for d in range(4) for o in ("horizontal", "vertical") for _ in range(400))
    rows += [[9, 0, "vertical", 1.0, float(k * 9), float(k * 9 + 5)] for k in range(5000)] + [[9, 0, "vertical", 2.0, float(k), float(k + 1)] for k in range(5000)]
    names = ["doc_id", "page_index", "orientation", "coordinate", "start", "end"]
    for size in (11, 997, 10_000):
        batches = (pd.DataFrame(rows[k : k + size], columns=names) for k in range(0, len(rows), size))
        assert [list(r) for pdf in R._runs(batches) for r in pdf.itertuples(index=False)] == brute(rows)
    joined = R.joined_segments(spark.createDataFrame(rows, "doc_id long, page_index int, orientation string, coordinate double, start double, end double"))
    assert sorted(list(r) for r in joined.collect()) == sorted(brute(rows))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    dealt = plan.splitlines()[next(k for k, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line) + 1]
    assert "= horizontal) AS orientation" in dealt  # a boolean is dealt and sorted, not the name


def test_cells_are_read_once_whatever_asks_for_them(spark):
    for query in (plans.par07_tolerance_texts, plans.chk14_tolerance_envelopes):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("rlike") + plan.lower().count("regexp_extract(") <= 2  # a datum's letter, and a value


def frames_by_trying_all(runs):
    """x0, y0, x1, y1, cells of the frames of one page's joined runs (doc, page, orientation, coordinate, start, end)."""
    flat, steep = [r[3:] for r in runs if r[2] == "horizontal"], [r[3:] for r in runs if r[2] == "vertical"]
    found = set()
    for top in flat:
        for bottom in flat:
            y0, y1 = top[0], bottom[0]
            if not R.LEAST_HEIGHT <= y1 - y0 <= R.MOST_HEIGHT:
                continue
            over = sorted((x, s, e) for x, s, e in steep if s <= y0 + R.AXIS and e >= y1 - R.AXIS)
            if any(s < y0 - R.AXIS or e > y1 + R.AXIS for _, s, e in over):
                continue
            cells = []
            for x, _, _ in over:
                if cells and not x - cells[-1] > R.AXIS:
                    cells[-1] = (cells[-1] + x) / 2
                else:
                    cells.append(x)
            if len(cells) < 3 or not R.LEAST_WIDTH <= cells[-1] - cells[0] <= R.MOST_WIDTH:
                continue
            covers = lambda line: line[1] <= cells[0] + R.AXIS and line[2] >= cells[-1] - R.AXIS  # noqa: E731, B023
            if covers(top) and covers(bottom) and sum(y0 - R.AXIS <= line[0] <= y1 + R.AXIS and covers(line) for line in flat) == 2:
                found.add((cells[0], y0, cells[-1], y1, tuple(cells)))
    return found


def drawn(rng, doc, page):
    """Tables, some with a line too many, a vertical too long, lines beside each other, or edges off by an eighth."""
    rows, off = [], lambda: rng.choice([0] * 9 + [0.125, -0.125, 0.25])
    for i in range(8):
        x, y, n, tall, step = rng.randrange(0, 300, 30), i * 52 + rng.choice([0, 0, 0, 13]), rng.randrange(2, 6), rng.choice([5, 8, 20, 20, 48, 49]), rng.choice([3, 8, 20, 20, 90])
        for at in [y, y + tall, *([y + 4] if rng.random() < 0.1 else [])]:
            rows.append((doc, page, "horizontal", at + off(), float(x), x + (n - 1) * step + off()))
        for k in range(n):
            rows += [(doc, page, "vertical", x + k * step + off(), y + off(), y + tall + off() + (30 if rng.random() < 0.02 else 0))] * rng.choice([1, 1, 2])
            if rng.random() < 0.2:
                rows.append((doc, page, "vertical", x + k * step + rng.choice([0.1, 0.2]), y + 0.2, y + tall - 0.2))
    return [(*r[:3], *map(float, r[3:])) for r in rows]


def test_frames_are_those_that_trying_all_finds(spark):
    """From segments, in one step of a page: neither joined lines nor their pairs are dealt again."""
    rng = random.Random(5)
    pages = {(d, p): drawn(rng, d, p) for d in range(60) for p in range(3)}
    pages[77, 0] = [(77, 0, "vertical", 1.0, 0.0, 9.0)]
    pages[78, 0] = [(78, 0, "horizontal", 1.0, 0.0, 9.0), (78, 0, "horizontal", 9.0, 0.0, float("nan"))]
    want = {(*key, *f) for key, rows in pages.items() for f in frames_by_trying_all(brute(sorted(rows)))}
    segments = [r for rows in pages.values() for r in rows]
    rng.shuffle(segments)
    lost = [(None, 0, *r[2:]) for r in segments[:40]]
    found = R.frames(spark.createDataFrame(segments + lost, "doc_id long, page_index int, orientation string, coordinate double, start double, end double"))
    got = [(r.doc_id, r.page_index, r.x0, r.y0, r.x1, r.y1, tuple(r.cells)) for r in found.collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want
    assert any(any(c * 8 % 1 for c in f[6]) for f in want)  # positions that were averaged are among them


def test_frames_do_not_depend_on_how_many_rows_are_looked_at_in_one_step(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((r[0], r[1], r[2] == "horizontal", *r[3:]) for d in range(9) for r in drawn(rng, d, 0))
    table = pa.Table.from_pandas(pd.DataFrame(rows, columns=["doc_id", "page_index", "orientation", "coordinate", "start", "end"]))
    whole = R._framed(table).to_pylist()
    monkeypatch.setattr(R, "_STEP", 3)
    assert len(whole) > 4 and R._framed(table).to_pylist() == whole


def test_texts_are_dealt_once_to_the_cell_of_their_centre(spark):
    rng = random.Random(4)
    frames = [(1, k % 2, f"f{k}", x := rng.uniform(-90, 300), y := rng.uniform(-90, 300), x + 60, y + 30, [x, x + 20, x + 60]) for k in range(40)]
    texts = [(1, k % 2, f"t{k}", x := rng.choice([rng.uniform(-90, 300), 64.0, 61.5]), y := rng.uniform(-90, 300), x + rng.choice([0, 5, 150]), y + rng.choice([0, 8, 70])) for k in range(600)]
    want = set()
    for f in frames:
        x0, y0, x1, y1 = f[3] - R.PADDING, f[4] - R.PADDING, f[5] + R.PADDING, f[6] + R.PADDING
        for t in texts:
            cx, cy, area = (t[3] + t[5]) / 2, (t[4] + t[6]) / 2, (t[5] - t[3]) * (t[6] - t[4])
            shared = max(0.0, min(t[5], x1) - max(t[3], x0)) * max(0.0, min(t[6], y1) - max(t[4], y0))
            if t[1] == f[1] and area > 0 and (x0 <= cx <= x1 and y0 <= cy <= y1 or shared >= 0.5 * area):
                want.add((f[1], f[2], t[2], 0 if cx <= f[7][1] else 1))
    f = spark.createDataFrame(frames, "doc_id long, page_index int, frame_id string, x0 double, y0 double, x1 double, y1 double, cells array<double>")
    t = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in texts], "doc_id long, page_index int, observation_id string, x0 double, y0 double, x1 double, y1 double")
    placed = R.frame_texts(f, t)
    got = [(r.page_index, r.frame_id, r.text_id, r.cell) for r in placed.collect()]
    assert len(got) == len(want) > 20 and set(got) == want
    assert placed._jdf.queryExecution().executedPlan().toString().count("Generate explode") <= 4  # two of the frames, in each of two printed plans
