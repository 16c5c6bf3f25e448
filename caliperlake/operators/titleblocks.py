"""Title blocks: lines in the lower right corner, values beside and above their labels, one suggestion for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliperlake.functions.geometry import angles_equal, interval_overlap
from caliperlake.functions.text import compact
from caliperlake.operators.spatial import PAGE

# Labels of the fields, and forms of their values.
LABELS = {"material_code": ("物料编码",), "drawing_number": ("图样代号",), "material": ("材质", "材料"), "revision": ("版本号",)}
ANCHORS = ("物料编码", "图样代号", "版本号")
CODE, REVISION = r"\A[A-Za-z0-9][A-Za-z0-9._/-]{2,63}\z", r"\A[A-Za-z0-9]{1,4}(?:[./-][A-Za-z0-9]{1,4})?\z"
IDEOGRAPH, STRUCTURE = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]", r"\A[0-9第共年月日页张./\-()（）]+\z"
_ALL = tuple(t for texts in LABELS.values() for t in texts)


def is_code(text: Column) -> Column:
    return text.rlike(CODE)


def is_material(text: Column) -> Column:
    return (F.char_length(text) <= 64) & ~text.isin(*_ALL) & text.rlike(r"[\p{L}\p{N}]")


def is_revision(text: Column) -> Column:
    return text.rlike(REVISION)


def is_name(text: Column) -> Column:
    """Holds an ideograph and is not page or date furniture."""
    return text.rlike(IDEOGRAPH) & ~text.rlike(STRUCTURE)


def title_lines(lines: DataFrame) -> DataFrame:
    """Level lines inside the page, whose centre is in its lower right corner, with their compact text; lines have angle, page_width and page_height."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= F.col("page_width")) & (F.col("y1") <= F.col("page_height"))
    corner = (cx >= F.col("page_width") * 0.65) & (cy >= F.col("page_height") * 0.80)
    kept = lines.where(angles_equal(F.col("angle"), F.lit(0.0), 2.0) & inside & corner).withColumn("text", compact(F.col("raw_text")))
    return kept.where("text <> ''")


# A text of a title block as it is held in its page's array.
_V = ("observation_id", "raw_text", "text", "x0", "y0", "x1", "y1", "page_width")


def _fields(texts: DataFrame) -> DataFrame:
    """Title lines -> a row for each field that a page has a label or a value of: page, field, n (how many labels or values), observation_id, raw_text and label_id of the value if there is one only.

    A page's lines meet in one array, which holds its lower right corner only, and each of the few labels passes over it once: nothing is joined, and the lines are made and dealt once.
    """
    keys = list(PAGE)
    pages = texts.groupBy(*keys).agg(F.collect_list(F.struct(*_V)).alias("lines"))
    among = lambda said: lambda t: t["text"].isin(*said)
    pages = pages.where(F.size(F.array_distinct(F.transform(F.filter("lines", among(ANCHORS)), lambda t: t["text"]))) >= 2)
    pages = pages.withColumn("values", F.filter("lines", lambda t: ~t["text"].isin(*_ALL)))
    labels = [F.struct(F.lit(name).alias("field"), F.filter("lines", among(said)).alias("labels")) for name, said in LABELS.items()]
    rows = pages.select(*keys, "values", F.explode(F.array(*labels)).alias("l")).select(*keys, "values", "l.field", "l.labels").where(F.size("labels") > 0)
    rows = rows.select(*keys, "field", F.size("labels").alias("_labels"), F.element_at("labels", 1).alias("label"), F.when(F.size("labels") == 1, F.col("values")).otherwise(F.slice("values", 1, 0)).alias("values"))
    field, label = F.col("field"), F.col("label")

    def belongs(v: Column) -> Column:
        gap, middle = v["x0"] - label["x1"], F.abs((v["y0"] + v["y1"]) / 2 - (label["y0"] + label["y1"]) / 2)
        level = F.greatest(F.lit(2.0), F.least(label["y1"] - label["y0"], v["y1"] - v["y0"]) * 0.4)
        kind = F.when(field == "material", is_material(v["text"])).otherwise(is_code(v["text"]))
        beside = (field != "revision") & gap.between(F.lit(1.0), label["page_width"] * 0.17) & (middle <= level) & kind
        rise = label["y0"] - v["y1"]
        above = (field == "revision") & rise.between(0.0, 45.0) & (interval_overlap(label["x0"], label["x1"], v["x0"], v["x1"]) >= 0.65) & is_revision(v["text"])
        return beside | above

    rows = rows.withColumn("found", F.filter("values", belongs)).withColumn("d", F.when((F.size("found") == 1) & (field == "drawing_number"), F.get("found", F.lit(0))))
    d = F.col("d")

    def names(v: Column) -> Column:
        rise, shift = d["y0"] - v["y1"], F.abs((v["x0"] + v["x1"]) / 2 - (d["x0"] + d["x1"]) / 2)
        return rise.between(10.0, 90.0) & (shift <= label["page_width"] * 0.08) & (interval_overlap(d["x0"], d["x1"], v["x0"], v["x1"]) >= 0.5) & is_name(v["text"]) & (v["observation_id"] != d["observation_id"])

    made = lambda name, n, found: F.struct(name.alias("field"), n.alias("n"), F.get(found, F.lit(0)).alias("v"))
    rows = rows.withColumn("named", F.when(d.isNotNull(), F.filter("values", names)))
    both = F.array(made(field, F.greatest("_labels", F.size("found")), F.col("found")), made(F.lit("material_name"), F.size(F.coalesce("named", F.slice("found", 1, 0))), F.col("named")))
    out = rows.select(*keys, label["observation_id"].alias("label_id"), "_labels", F.explode(both).alias("r")).where((F.col("r.n") > 1) | F.col("r.v").isNotNull())
    return out.select(*keys, "r.field", "r.n", F.col("r.v.observation_id").alias("observation_id"), F.col("r.v.raw_text").alias("raw_text"), "label_id")


def suggestions(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title lines -> (suggestions of pages, fields that a page leaves ambiguous).

    A page needs two different anchor labels.  A field with one label takes the one value of its kind in the row to the right (or, for the revision,
    above in the column); two labels or values make it ambiguous.  The one name above the drawing number is the material's name.
    """
    found = _fields(texts)
    return found.where("n = 1").select(*PAGE, "field", F.trim("raw_text").alias("value"), "observation_id", "label_id"), found.where("n > 1").select("doc_id", "field").distinct()


def unique_suggestions(texts: DataFrame) -> DataFrame:
    """Of each document's title lines the fields with one suggestion on all its pages, none of which leaves the field ambiguous."""
    one = _fields(texts).groupBy("doc_id", "field").agg(F.count("*").alias("n"), F.max("n").alias("most"), F.min(F.struct("page_index", F.trim("raw_text").alias("value"), "observation_id")).alias("s"))
    return one.where("n = 1 and most = 1").select("doc_id", "field", "s.page_index", "s.value", "s.observation_id")
