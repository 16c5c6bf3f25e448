import itertools
import math
import random
import re

from caliperlake.operators import marks as M
from caliperlake.operators import routing

TEXTS = "doc_id long, visual_id string, raw_text string, x0 double, y0 double, x1 double, y1 double, note string"
PATHS = "doc_id long, visual_id string, place int, opcode string, ax double, ay double, bx double, by double, note string"


def run(spark, texts, paths, ids):
    visuals = spark.createDataFrame([(1, i, "x") for i in ids], "doc_id long, visual_id string, note string")
    t = spark.createDataFrame([(1, *r, "t") for r in texts], TEXTS)
    p = spark.createDataFrame([(1, *r, "p") for r in paths], PATHS)
    return {r.visual_id: (r.n_boxes, r.n_triangles, r.datum_ok, r.revision_ok) for r in M.reference_marks(visuals, t.repartition(2), p.repartition(3)).collect()}


def brute(texts, paths):
    """Counts of boxes and triangles of one visual, by trying every set of vertices."""
    lines = [p for p in paths if p[2] == "l"]
    letters = [t for t in texts if re.fullmatch("[A-Z]", t[1])]
    short = [t for t in texts if re.fullmatch("[A-Z0-9]{1,3}", t[1])]
    seen, edges = [], set()
    for p in lines:
        ends = []
        for v in (p[3:5], p[5:7]):
            k = next((k for k, w in enumerate(seen) if math.dist(v, w) <= 0.5), None)
            if k is None:
                seen.append(v)
                k = len(seen) - 1
            ends.append(k)
        edges.add(frozenset(ends))
    has = lambda a, b: frozenset((a, b)) in edges and a != b
    hold = lambda b, t: b[0] <= t[2] + 2 and b[1] <= t[3] + 2 and b[2] >= t[4] - 2 and b[3] >= t[5] - 2
    boxes, found = set(), set()
    if len(letters) == 1:
        candidates = [p[3:] for p in paths if p[2] == "re"]
        for four in itertools.combinations(range(len(seen)), 4):
            for b, c, d in itertools.permutations(four[1:]):
                ring = [four[0], b, c, d]
                sides = [(ring[k], ring[(k + 1) % 4]) for k in range(4)]
                if not all(has(*s) and min(abs(seen[s[0]][0] - seen[s[1]][0]), abs(seen[s[0]][1] - seen[s[1]][1])) <= 0.5 for s in sides):
                    continue
                xs, ys = zip(*(seen[v] for v in ring), strict=True)
                box = (min(xs), min(ys), max(xs), max(ys))
                corners = itertools.product(box[::2], box[1::2])
                if box[2] - box[0] > 0.5 and box[3] - box[1] > 0.5 and all(any(math.dist(c, seen[v]) <= 0.5 for v in ring) for c in corners):
                    candidates.append(box)
        boxes = {tuple(round(v, 3) for v in b) for b in candidates if hold(b, letters[0])}
    if len(short) == 1:
        cx, cy = (short[0][2] + short[0][4]) / 2, (short[0][3] + short[0][5]) / 2
        for three in itertools.combinations(range(len(seen)), 3):
            if not all(has(*s) for s in itertools.combinations(three, 2)):
                continue
            xs, ys = zip(*(seen[v] for v in three), strict=True)
            area = abs(xs[0] * (ys[1] - ys[2]) + xs[1] * (ys[2] - ys[0]) + xs[2] * (ys[0] - ys[1])) / 2
            if 4 <= max(xs) - min(xs) <= 24 and 4 <= max(ys) - min(ys) <= 24 and area > 0.01 and min(xs) - 2 <= cx <= max(xs) + 2 and min(ys) - 2 <= cy <= max(ys) + 2:
                found.add(tuple(sorted((round(x, 3), round(y, 3)) for x, y in zip(xs, ys, strict=True))))
    return len(boxes), len(found), len(boxes) == 1, len(found) == 1


def test_marks_are_those_of_trying_all_vertices(spark):
    rng, texts, paths, want = random.Random(3), [], [], {}
    for k in range(90):
        v, step = f"v{k:02}", rng.choice([0.6, 5.0, 8.0, 30.0])
        points = [(i * step + rng.choice([0, 0.125, 0.25]), j * step + rng.choice([0, 0.125])) for i in range(3) for j in range(3)]
        own = []
        for n in range(rng.randrange(3, 26)):
            a, b = rng.sample(points, 2)
            if rng.random() < 0.8 and step != 0.6:
                b = min((p for p in points if p != a), key=lambda p: (abs(p[0] - a[0]) + abs(p[1] - a[1])) * rng.uniform(0.8, 2.2))
            own.append((v, n, "l", *a, *b))
        own += [(v, 100 + n, "re", 0.0, 0.0, step + n, step) for n in range(rng.choice([0, 0, 0, 1, 2]))]
        x, y = rng.uniform(0, step), rng.uniform(0, step)
        said = [(v, t, x, y, x + 1.0, y + 1.0) for t in rng.choice([["A"], ["A"], ["A"], ["12"], ["A", "B"], ["abc", "A"]])]
        texts, paths, want[v] = texts + said, paths + own, brute(said, own)
    assert run(spark, texts, paths, want) == want
    assert sum(w[2] for w in want.values()) > 5 and sum(w[3] for w in want.values()) > 5 and any(w[0] > 1 for w in want.values()) and any(w[1] > 1 for w in want.values())


def test_marks_of_broken_rows_repeats_and_empty_tables(spark):
    ring = lambda v, s=10.0: [(v, 0, "l", 0.0, 0.0, s, 0.0), (v, 1, "l", s, 0.0, s, s), (v, 2, "l", s, s, 0.0, s), (v, 3, "l", 0.0, s, 0.0, 0.25)]
    text = lambda v, t="A": (v, t, 4.0, 4.0, 6.0, 6.0)
    texts = [text("plain"), text("null line"), text("null box"), text("twice"), text("twice"), (("bare"), "A", None, None, None, None), text("wide", " Ａ "), text("none", None), text("long", "A" * 100_000), text("same")]
    paths = ring("plain") + ring("plain") + ring("null line") + [("null line", 9, "l", 1.0, None, 2.0, 2.0)] + ring("null box") + [("null box", 9, "re", 5.0, 5.0, 5.0, 9.0)]
    paths += ring("twice") + ring("bare") + ring("wide") + ring("none") + ring("long") + ring("same") + [("same", 9, "re", 0.0, 0.0, 10.0, 10.0), ("same", 10, None, None, None, None, None)]
    ids = ["plain", "null line", "null box", "twice", "bare", "wide", "none", "long", "same", "alone"]
    got = run(spark, texts, paths, ids)
    assert {k for k, v in got.items() if v[2]} == {"plain", "wide", "same"} and not any(v[3] for v in got.values()) and len(got) == len(ids)
    assert run(spark, [], [], []) == {} and run(spark, [], [], ["a"]) == {"a": (0, 0, False, False)}


def test_a_long_line_of_pieces_and_a_fan_of_lines(spark):
    rail = [("rail", k, "l", float(k), 0.0, float(k + 1), 0.0) for k in range(3000)]
    fan = [("fan", k, "l", 0.0, 0.0, 300.0 * math.cos(k / 500), 300.0 * math.sin(k / 500)) for k in range(3000)]
    got = run(spark, [("rail", "A", 4.0, 4.0, 6.0, 6.0), ("fan", "A", 4.0, 4.0, 6.0, 6.0)], rail + fan, ["rail", "fan"])
    assert set(got.values()) == {(0, 0, False, False)}


def test_a_reference_family_needs_its_own_mark_and_no_other(spark):
    from pyspark.sql import functions as F

    base = {"boxed": True, "geometry_matches": True, "n_texts": 1, "n_distinct": 1, "n_known": 1, "n_doubled": 0, "same_page": True, "n_overlapping": 0, "n_exact": 0, "exact_type": "radius", "n_coarse": 0, "coordinates_agree": True, "source_value": "1", "candidate_value": "1", "projection_conflict": False}
    rows = [(family, datum, revision) for family in ("datum_reference", "revision_marker") for datum in (True, False, None) for revision in (True, False)]
    df = spark.createDataFrame(rows, "family string, datum_ok boolean, revision_ok boolean")
    get = lambda n: F.array("family") if n == "hypotheses" else F.col(n) if n in df.columns else F.lit(base[n])
    for r in df.select("*", routing.resolution(get).alias("r"), routing.completed_families(get).alias("f")).collect():
        own, other = (r.datum_ok, r.revision_ok) if r.family == "datum_reference" else (r.revision_ok, r.datum_ok)
        reasons = ["local_evidence_conflict"] if other else ["deterministic_geometry_complete", "local_projection_complete"] if own else ["local_parse_incomplete"]
        assert (r.r.family, r.r.reasons) == (r.family if own and not other else None, reasons)
        assert r.f == ([] if bool(r.datum_ok) == bool(r.revision_ok) else ["datum_reference" if r.datum_ok else "revision_marker"])
