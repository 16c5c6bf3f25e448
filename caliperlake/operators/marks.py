"""Marks of the reference families: a datum letter in its box, a revision number in its triangle, proved from the lines around the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliperlake.functions.text import normalised
from caliperlake.operators.routing import JOINED, joined_ends
from caliperlake.operators.spatial import by_group
from caliperlake.scratch import written

# Fixed values, in points: slack around a text, sides and least area of a triangle, decimals by which two shapes are one.
SLACK, LEAST_SIDE, MOST_SIDE, LEAST_AREA, DECIMALS = 2.0, 4.0, 24.0, 0.01, 3
LETTER, MARK = r"^[A-Z]\z", r"^[A-Z0-9]{1,3}\z"
KEY = ["doc_id", "visual_id"]
_BOX, _ENDS = ("x0", "y0", "x1", "y1"), ("ax", "ay", "bx", "by")


def _finite(*columns: str) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return good


def _near(a: Column, b: Column, by: float) -> Column:
    return F.abs(a - b) <= by


def _rounded(*values: Column) -> Column:
    return F.struct(*(F.bround(v, DECIMALS).alias(f"c{k}") for k, v in enumerate(values)))


def _holds(box: tuple, text: Column) -> Column:
    return (box[0] <= text["x0"] + SLACK) & (box[1] <= text["y0"] + SLACK) & (box[2] >= text["x1"] - SLACK) & (box[3] >= text["y1"] - SLACK)


def _located(rows: list) -> list[tuple]:
    return [(*r[:2], *a, *b) for r, (a, b) in zip(rows, joined_ends(rows), strict=True) if a != b]


def _ranked(edges: DataFrame) -> DataFrame:
    """Edges in both directions with their ends as vertices (degree, id, x, y), which compare by degree and then by number."""
    end = lambda e: (F.col(f"{e}{c}").alias(c or "id") for c in ("", "x", "y"))
    u, v = F.struct(*end("u")), F.struct(*end("v"))
    both = edges.distinct().select(*KEY, F.explode(F.array(F.struct(u.alias("p"), v.alias("q")), F.struct(v.alias("p"), u.alias("q")))).alias("e")).select(*KEY, F.col("e.p").alias("p"), F.col("e.p.id").alias("u"), F.col("e.q.id").alias("v"))
    rank = both.groupBy(*KEY, "u").agg(F.count("*").alias("degree"), F.min("p").alias("p")).select(*KEY, "u", F.struct("degree", "p.id", "p.x", "p.y").alias("r"))
    at = lambda end: rank.select(*KEY, F.col("u").alias(end), F.col("r").alias(f"r{end}"))
    return both.select(*KEY, "u", "v").join(at("u"), [*KEY, "u"]).join(at("v"), [*KEY, "v"]).select(*KEY, "ru", "rv")


def _up(ranked: DataFrame, a: str, b: str) -> DataFrame:
    return ranked.where("ru < rv").select(*KEY, F.col("ru").alias(a), F.col("rv").alias(b))


def rectangles(edges: DataFrame) -> DataFrame:
    """doc_id, visual_id, x0 .. y1 of each four-sided cycle whose sides are level or upright and whose corners are those of its box.

    A cycle is two ways of two sides between opposite corners, of which one is its greatest vertex by degree; ways lead down from there, and only ways with a corner between are kept, so a long line
    of many pieces makes none.
    """
    ranked = _ranked(edges.where(_near(F.col("ux"), F.col("vx"), JOINED) | _near(F.col("uy"), F.col("vy"), JOINED)))
    top, far, u, w = (F.col(c) for c in ("top", "far", "u", "w"))
    level = lambda axis, *p: F.greatest(*(v[axis] for v in p)) - F.least(*(v[axis] for v in p)) <= 2 * JOINED
    corner = (level("x", u, far) & level("y", u, top)) | (level("y", u, far) & level("x", u, top)) | level("x", u, top, far) | level("y", u, top, far)
    ways = _up(ranked, "u", "top").join(ranked.select(*KEY, F.col("ru").alias("u"), F.col("rv").alias("far")), [*KEY, "u"]).where((far < top) & corner)
    four = ways.join(ways.withColumnRenamed("u", "w"), [*KEY, "top", "far"]).where(u["id"] < w["id"])
    end = lambda fold, axis: fold(*(v[axis] for v in (top, far, u, w)))
    x0, y0, x1, y1 = (end(f, a) for f, a in ((F.least, "x"), (F.least, "y"), (F.greatest, "x"), (F.greatest, "y")))
    boxes = four.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
    on = lambda v, x, y: F.sqrt((v["x"] - F.col(x)) * (v["x"] - F.col(x)) + (v["y"] - F.col(y)) * (v["y"] - F.col(y))) <= JOINED
    held = F.lit(True)
    for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")):
        held = held & (on(top, x, y) | on(far, x, y) | on(u, x, y) | on(w, x, y))
    return boxes.where(f"x1 - x0 > {JOINED} AND y1 - y0 > {JOINED}").where(held).select(*KEY, *_BOX)


def triangles(edges: DataFrame) -> DataFrame:
    """doc_id, visual_id and the three vertices a, b, c of each triangle, found once at its least vertex by degree."""
    ranked = _ranked(edges)
    return _up(ranked, "a", "b").join(_up(ranked, "a", "c"), [*KEY, "a"]).where("b < c").join(_up(ranked, "b", "c"), [*KEY, "b", "c"]).select(*KEY, "a", "b", "c")


def reference_marks(visuals: DataFrame, texts: DataFrame, paths: DataFrame) -> DataFrame:
    """n_boxes, n_triangles, datum_ok and revision_ok of each visual.

    visuals: doc_id, visual_id; texts of visuals: doc_id, visual_id, raw_text, x0 .. y1; paths of visuals: doc_id, visual_id, place, opcode (l: line, re: box), ax, ay, bx, by.

    A datum is proved by one letter and one box around it, drawn as a box or as lines; a revision by one short token and one small triangle around its centre.  Shapes that are equal to three decimals are one.
    A text that is there twice counts twice, so it proves nothing.  A line with a null or infinite end leaves both open, a box with one, or without area, the datum.  Texts without a box are in no shape;
    visuals without texts or paths, and null ids, get false.  Further columns are left out.  Only visuals that have such a token have their lines joined, a visual at a time in a sorted stream.
    """
    said = texts.select(*KEY, normalised(F.col("raw_text")).alias("_t"), F.struct(*_BOX).alias("_b"))
    letter, mark = F.coalesce(F.col("_t").rlike(LETTER), F.lit(False)), F.coalesce(F.col("_t").rlike(MARK), F.lit(False))
    tokens = said.groupBy(*KEY).agg(F.count_if(letter).alias("n_letters"), F.count_if(mark).alias("n_marks"), F.max(F.when(letter, F.col("_b"))).alias("letter"), F.max(F.when(mark, F.col("_b"))).alias("mark"))
    line, box = F.col("opcode") == "l", F.col("opcode") == "re"
    broken = paths.groupBy(*KEY).agg(F.coalesce(F.bool_or(line & ~_finite(*_ENDS)), F.lit(False)).alias("bad_line"), F.coalesce(F.bool_or(box & ~(_finite(*_ENDS) & (F.col("bx") > F.col("ax")) & (F.col("by") > F.col("ay")))), F.lit(False)).alias("bad_box"))
    live = tokens.where("n_letters = 1 OR n_marks = 1").join(broken, KEY).where("NOT bad_line")
    live = live.select(*KEY, F.when(F.expr("n_letters = 1 AND NOT bad_box"), F.col("letter")).alias("letter"), F.when(F.col("n_marks") == 1, F.col("mark")).alias("mark"))
    kinds = dict(visuals.dtypes)
    schema = f"doc_id {kinds['doc_id']}, visual_id {kinds['visual_id']}, u int, ux double, uy double, v int, vx double, vy double"
    lines = paths.where(line).select(*KEY, "place", *_ENDS).join(live.select(*KEY), KEY, "left_semi")
    edges = written(by_group(lines, KEY, ["place", *_ENDS], _located, schema), "marks")

    # Two sides that are dealt by the key are dealt anew after their union: adaptive execution may deal one of them in another way, and the union would still count as dealt.
    wanted = live.where("letter IS NOT NULL").select(*KEY, "letter")
    drawn = paths.where(box).select(*KEY, *(F.col(c).alias(n) for c, n in zip(_ENDS, _BOX, strict=True))).unionByName(rectangles(edges.join(wanted.select(*KEY), KEY, "left_semi"))).repartition(*KEY)
    around = drawn.join(wanted, KEY).where(_holds(tuple(F.col(c) for c in _BOX), F.col("letter")))
    n_boxes = around.groupBy(*KEY).agg(F.count_distinct(_rounded(*(F.col(c) for c in _BOX))).alias("n_boxes"))

    centre = live.where("mark IS NOT NULL").select(*KEY, ((F.col("mark.x0") + F.col("mark.x1")) / 2).alias("cx"), ((F.col("mark.y0") + F.col("mark.y1")) / 2).alias("cy"))
    reach = MOST_SIDE + SLACK + JOINED
    close = edges.join(centre, KEY).where(" AND ".join(f"abs({e}{a} - c{a}) <= {reach}" for e in "uv" for a in "xy")).select(edges.columns)
    a, b, c = (F.col(n) for n in "abc")
    x, y = ([v[axis] for v in (a, b, c)] for axis in "xy")
    width, height = F.greatest(*x) - F.least(*x), F.greatest(*y) - F.least(*y)
    area = F.abs(x[0] * (y[1] - y[2]) + x[1] * (y[2] - y[0]) + x[2] * (y[0] - y[1])) / 2
    inside = F.col("cx").between(F.least(*x) - SLACK, F.greatest(*x) + SLACK) & F.col("cy").between(F.least(*y) - SLACK, F.greatest(*y) + SLACK)
    small = triangles(close).join(centre, KEY).where(width.between(LEAST_SIDE, MOST_SIDE) & height.between(LEAST_SIDE, MOST_SIDE) & (area > LEAST_AREA) & inside)
    n_triangles = small.groupBy(*KEY).agg(F.count_distinct(F.array_sort(F.array(*(_rounded(v["x"], v["y"]) for v in (a, b, c))))).alias("n_triangles"))
    out = visuals.select(*KEY).distinct().join(n_boxes, KEY, "left").join(n_triangles, KEY, "left").fillna(0, ["n_boxes", "n_triangles"])
    return out.withColumns({"datum_ok": F.col("n_boxes") == 1, "revision_ok": F.col("n_triangles") == 1})
