"""Layout profiles: pages that match a known form, roles of its cells, watermarks, and what layout says of a text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions.geometry import Box, POINTS_TO_MM, angles_equal
from caliperlake.operators.spatial import PAGE

# Fixed values, in millimetres: grids of the forms' tables.
TITLE_X, TITLE_Y = (0.0, 12.0, 24.0, 40.0, 52.0, 64.0, 80.0, 106.0, 118.0, 130.0, 144.0, 180.0), (0.0, 7.0, 14.0, 18.0, 21.0, 28.0, 35.0, 38.0, 42.0, 47.0, 49.0, 56.0)
REVISION_X, REVISION_Y = (0.0, 10.0, 90.0), (0.0, 5.0, 15.0, 25.0, 35.0)
ARCHIVE_X, ARCHIVE_Y = (0.0, 25.0), (0.0, 7.0, 17.0, 24.0, 34.0, 41.0, 51.0, 58.0, 68.0, 75.0, 85.0, 92.0, 102.0)
# Tolerances of page size, grid, axis and position, least segment, boundary, lattice; labels of the anchors.
PAGE_TOLERANCE, GRID_TOLERANCE, AXIS_TOLERANCE, CLUSTER_GAP, LEAST_SEGMENT, BOUNDARY, EDGE, LATTICE_TOLERANCE, LEAST_WATERMARKS = 0.5, 1.0, 0.05, 0.1, 1.0, 1.0, 1e-9, 2.0, 9
TITLE_ANCHORS, REVISION_ANCHORS, ARCHIVE_ANCHOR = ("物料编码", "图样代号", "比例", "重量"), ("标记", "更改描述"), "旧底图总号"


class Profile(NamedTuple):
    name: str
    width: float
    height: float
    spacing: tuple[float, float]

    @property
    def boxes(self) -> dict[str, tuple[float, float, float, float]]:
        w, h = self.width, self.height
        return {"body_frame": (25.0, 5.0, w - 5.0, h - 5.0), "title_grid": (w - 185.0, h - 61.0, w - 5.0, h - 5.0), "revision_grid": (w - 95.0, 5.0, w - 5.0, 40.0), "archive_grid": (0.0, h - 107.0, 25.0, h - 5.0)}


PROFILES = (Profile("a3-landscape/1", 420.0, 297.0, (100.0, 80.0)), Profile("a4-portrait/1", 210.0, 297.0, (65.0, 80.0)), Profile("a3-portrait/1", 297.0, 420.0, (100.0, 90.0)))


def expected_lines() -> list[tuple[str, str, str, float, float, float]]:
    """(profile, grid, axis, position, span start, span end) of every line of every form."""
    out = []
    for p in PROFILES:
        for grid, xs, ys in (("body_frame", None, None), ("title_grid", TITLE_X, TITLE_Y), ("revision_grid", REVISION_X, REVISION_Y), ("archive_grid", ARCHIVE_X, ARCHIVE_Y)):
            x0, y0, x1, y1 = p.boxes[grid]
            out += [(p.name, grid, "x", x0 + x, y0, y1) for x in xs or (0.0, x1 - x0)]
            out += [(p.name, grid, "y", y0 + y, x0, x1) for y in ys or (0.0, y1 - y0)]
    return out


def roles() -> list[tuple[str, str, str, str, float, float, float, float, str | None, float | None]]:
    """(profile, region, role, cell, x0, y0, x1, y1, expected text, expected centre) of every cell of every form."""
    out = []
    for p in PROFILES:
        w, h = p.width, p.height
        x0, y0, x1, y1 = p.boxes["title_grid"]
        out += [(p.name, "title_block", "title_approval_context", "title-approval-context", x0, y0, x0 + 80.0, y1, None, None), (p.name, "title_block", "title_metadata_value", "title-metadata-value", x0 + 80.0, y0, x1, y1, None, None)]
        x0, y0, x1, _ = p.boxes["revision_grid"]
        out.append((p.name, "revision_table", "revision_header", "revision-header", x0, y0, x1, y0 + 5.0, None, None))
        for k, top in enumerate((y0 + 5.0, y0 + 15.0, y0 + 25.0), 1):
            out += [(p.name, "revision_table", "revision_marker", f"revision-marker-{k}", x0, top, x0 + 10.0, top + 10.0, None, None), (p.name, "revision_table", "revision_description", f"revision-description-{k}", x0 + 10.0, top, x1, top + 10.0, None, None)]
        x0, y0, x1, _ = p.boxes["archive_grid"]
        for k, (a, b) in enumerate(zip(ARCHIVE_Y[:-1], ARCHIVE_Y[1:], strict=True)):
            kind = ("label", "record")[k % 2]
            out.append((p.name, "archive_strip", f"archive_{kind}", f"archive-{kind}-{k // 2 + 1}", x0, y0 + a, x1, y0 + b, None, None))
        for band, top, low in (("top", 0.0, 5.0), ("bottom", h - 5.0, h)):
            out += [(p.name, "page_frame", "page_frame_number", f"page-frame-{band}-1", 0.0, top, w / 2.0, low, "1", w / 4.0), (p.name, "page_frame", "page_frame_number", f"page-frame-{band}-2", w / 2.0, top, w, low, "2", w * 3.0 / 4.0)]
    return out


def profile_of(width_pt: Column, height_pt: Column, rotation: Column) -> Column:
    """The form whose page size a page has; forms differ by more than the tolerance, so one at most."""
    name = F.lit(None).cast("string")
    for p in PROFILES:
        near = lambda v, mm: F.abs(v * POINTS_TO_MM - mm) <= PAGE_TOLERANCE
        name = F.when((rotation == 0) & near(width_pt, p.width) & near(height_pt, p.height), p.name).otherwise(name)
    return name


def _line_matches(pages: DataFrame, segments: DataFrame, expected: DataFrame) -> DataFrame:
    """Lines of a page's form that exactly one position of its segments matches.  Whole millimetres are a join key, so no page meets all lines."""
    x0, y0, x1, y1 = (F.col(c) * POINTS_TO_MM for c in ("x0", "y0", "x1", "y1"))
    sides = lambda a, b: (F.least(a, b), F.greatest(a, b))
    drawn = segments.select(*PAGE, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    axes = F.array_compact(F.array(
        F.when(F.abs(x1 - x0) <= AXIS_TOLERANCE, F.struct(F.lit("x").alias("axis"), ((x0 + x1) / 2).alias("at"), sides(y0, y1)[0].alias("start"), sides(y0, y1)[1].alias("end"))),
        F.when(F.abs(y1 - y0) <= AXIS_TOLERANCE, F.struct(F.lit("y").alias("axis"), ((y0 + y1) / 2).alias("at"), sides(x0, x1)[0].alias("start"), sides(x0, x1)[1].alias("end"))),
    ))
    drawn = drawn.select(*PAGE, F.explode(axes).alias("s")).select(*PAGE, "s.*", F.floor("s.at").alias("mm"))
    wanted = expected.withColumn("mm", F.explode(F.sequence(F.floor(F.col("position") - GRID_TOLERANCE), F.floor(F.col("position") + GRID_TOLERANCE))))
    near = drawn.join(pages.select(*PAGE, "profile"), list(PAGE)).join(F.broadcast(wanted), ["profile", "axis", "mm"])  # the lines of three forms
    shared = F.least("end", "span_end") - F.greatest("start", "span_start")
    near = near.where((F.abs(F.col("at") - F.col("position")) <= GRID_TOLERANCE) & (shared >= LEAST_SEGMENT))
    sorted_ = near.groupBy(*PAGE, "profile", "grid", "axis", "position").agg(F.array_sort(F.collect_set("at")).alias("p"))
    apart = F.exists(F.sequence(F.lit(1), F.size("p")), lambda i: (i > 1) & (F.element_at("p", i) - F.element_at("p", F.greatest(i - 1, F.lit(1))) > CLUSTER_GAP))
    return sorted_.where(~apart)


def matched_profiles(pages: DataFrame, segments: DataFrame, texts: DataFrame, expected: DataFrame) -> DataFrame:
    """Pages of a form's size whose lines and labels are that form's: profile and the evidence, by code.

    pages (page, width_pt, height_pt, rotation), segments (page, x0 .. y1 in points), texts (page, text, compact).
    """
    keys = list(PAGE)
    known = pages.withColumn("profile", profile_of(F.col("width_pt"), F.col("height_pt"), F.col("rotation"))).where("profile is not null")
    need = F.broadcast(expected.groupBy("profile", "grid").agg(F.count("*").alias("need")))
    grids = _line_matches(known, segments, expected).groupBy(*keys, "profile", "grid").agg(F.count("*").alias("have")).join(need, ["profile", "grid"]).where("have = need")
    drawn = grids.groupBy(*keys, "profile").agg(F.array_sort(F.collect_set("grid")).alias("geometry")).where(F.array_contains("geometry", "body_frame") & (F.size("geometry") >= 3))
    has = lambda t: F.bool_or(F.col("text") == t)
    title = sum((F.coalesce(has(t), F.lit(False)).cast("int") for t in TITLE_ANCHORS), F.lit(0)) >= 3
    codes = F.array(F.when(has(ARCHIVE_ANCHOR), "archive_anchor"), F.when(has(REVISION_ANCHORS[0]) & has(REVISION_ANCHORS[1]), "revision_anchor_quorum"), F.when(title, "title_anchor_quorum"))
    said = texts.groupBy(*keys).agg(F.array_compact(codes).alias("labels")).where(F.size("labels") >= 2)
    return drawn.join(said, keys).select(*keys, "profile", "geometry", "labels")


def assignments(obs: DataFrame, pages: DataFrame, cells: DataFrame) -> DataFrame:
    """The one cell of its page's form that holds each level text whole, with its distance to the cell's boundary and whether it touches the page's edge.

    obs (page, observation_id, text, x0 .. y1 in points, angle), pages (page, profile, height_mm); a text that fits two cells, or none, has no row.
    """
    b = Box(*(F.col(c) * POINTS_TO_MM for c in ("x0", "y0", "x1", "y1")))
    level = obs.where(angles_equal(F.col("angle"), F.lit(0.0), 2.0)).select(*PAGE, "observation_id", "text", *(v.alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)))
    both = level.join(pages.select(*PAGE, "profile", "height_mm"), list(PAGE)).join(F.broadcast(cells), "profile")  # 25 cells a form
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    distance = F.least(F.col("x0") - F.col("cx0"), F.col("y0") - F.col("cy0"), F.col("cx1") - F.col("x1"), F.col("cy1") - F.col("y1"))
    said = F.col("expected_text").isNull() | ((F.col("text") == F.col("expected_text")) & (F.abs(cx - F.col("expected_x")) <= GRID_TOLERANCE))
    fits = both.where((cx >= F.col("cx0")) & (cx <= F.col("cx1")) & (cy >= F.col("cy0")) & (cy <= F.col("cy1")) & (distance >= 0) & said)
    edge = (F.col("region") == "page_frame") & (((F.col("cy0") == 0) & (F.abs(F.col("y0")) <= EDGE)) | ((F.col("cy1") == F.col("height_mm")) & (F.abs(F.col("y1") - F.col("height_mm")) <= EDGE)))
    one = fits.groupBy(*PAGE, "observation_id", "text").agg(F.count("*").alias("n"), F.min(F.struct("region", "role", "cell", distance.alias("distance"), edge.alias("outer_edge"))).alias("a"))
    return one.where("n = 1").select(*PAGE, "observation_id", "text", "a.*")


def preserved(assigned: DataFrame, engineering: Column, visual: Column) -> DataFrame:
    """Assigned texts that stay open to inspection: too near a boundary, or descriptions with an engineering meaning or a drawing beside them;
    and then every description of the same row."""
    near = (F.col("distance") < BOUNDARY) & ~F.col("outer_edge")
    row = F.col("role") == "revision_description"
    own = near | (row & (engineering | visual))
    spread = F.bool_or(row & own).over(Window.partitionBy("doc_id", F.when(row, F.col("cell"))))
    return assigned.withColumn("preserved", own | (row & spread))


# Texts of the forms' own labels, by cell.
TITLE_LABELS = ("更改文件号", "版本号", "设计", "签名", "年月日标准化", "年月日", "校对", "工艺", "批准", "审核", "重量", "重量/kg", "比例", "图样代号", "物料编码", "第一角法", "表面积", "共张", "第张")
ARCHIVE_LABELS = ("借通用件登记", "描图", "校描", "旧底图总号", "签字", "日期")


def layout_disposition(text: Column, preserved_: Column) -> Column:
    """Struct (disposition, reason) of a text in a form's cell; null where layout decides nothing.  Uses region, role, cell, distance and outer_edge."""
    region, role, cell = F.col("region"), F.col("role"), F.col("cell")
    made = lambda d, r: F.struct(F.lit(d).alias("disposition"), F.lit(r).alias("reason"))
    number = F.substring_index(cell, "-", -1)
    label = F.lit(False)
    for k, said in enumerate(ARCHIVE_LABELS, 1):
        label = label | ((cell == f"archive-label-{k}") & (text == said))
    return (
        F.when((role == "page_frame_number") & (text == number) & ((F.col("distance") >= BOUNDARY) | F.col("outer_edge")), made("non_inspection", "page_frame_number"))
        .when(F.col("distance") < BOUNDARY, F.lit(None))
        .when((role == "revision_marker") & (text == number), made("reference_context", "revision_marker"))
        .when(preserved_, F.lit(None))
        .when((region == "title_block") & text.isin(*TITLE_LABELS), made("non_inspection", "title_fixed_label"))
        .when(role == "title_metadata_value", made("reference_context", "title_metadata_value"))
        .when(role == "title_approval_context", made("reference_context", "title_approval_context"))
        .when((role == "revision_header") & text.isin(*REVISION_ANCHORS), made("non_inspection", "revision_header"))
        .when(role == "revision_description", made("reference_context", "revision_description"))
        .when(label, made("non_inspection", "archive_label"))
        .when(role == "archive_record", made("reference_context", "archive_record"))
    )


def watermarks(texts: DataFrame, pages: DataFrame, angle: float = -30.0) -> DataFrame:
    """All rotated equal texts of a page, if some of them lie on a lattice of its form's spacing: nine cells, two columns, three rows, no cell twice.

    texts (page, observation_id, text, cx, cy in mm, angle), pages (page, sx, sy).  Texts of one lattice have the same residue modulo the spacing, so a text votes for the
    cell of its residue and meets only texts of that cell and those around it: of texts that lie anywhere, one in some hundreds.
    """
    keys = [*PAGE, "text"]
    turned = texts.where(angles_equal(F.col("angle"), F.lit(angle), 2.0)).join(pages, list(PAGE))
    enough = turned.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("n") >= LEAST_WATERMARKS).drop("n")
    # Residues go round, so each axis has a whole number of cells, each wider than the tolerance.
    around = lambda s: F.greatest(F.floor(F.col(s) / (1.25 * LATTICE_TOLERANCE)), F.lit(1))
    cell = lambda v, s: F.least(F.floor(F.pmod(F.col(v), F.col(s)) / F.col(s) * around(s)), around(s) - 1)
    nearby = lambda v, s: F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(v, s) + d, around(s)))))
    own = enough.withColumns({"_bx": cell("cx", "sx"), "_by": cell("cy", "sy")})
    other = enough.select(*keys, F.col("observation_id").alias("other_id"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), nearby("cx", "sx").alias("_bx"), "sy", "cy").withColumn("_by", nearby("cy", "sy")).drop("sy", "cy")
    step = lambda a, b, s: F.bround((F.col(a) - F.col(b)) / F.col(s))
    pairs = own.join(other, [*keys, "_bx", "_by"]).withColumns({"col": step("ox", "cx", "sx"), "line": step("oy", "cy", "sy")})
    on = (F.abs(F.col("ox") - F.col("cx") - F.col("col") * F.col("sx")) <= LATTICE_TOLERANCE) & (F.abs(F.col("oy") - F.col("cy") - F.col("line") * F.col("sy")) <= LATTICE_TOLERANCE)
    # One pass over the pairs: three distinct counts would write each of them four times.
    cells = pairs.where(on).groupBy(*keys, "observation_id").agg(F.count("*").alias("n"), F.collect_set(F.struct("col", "line")).alias("cells"))
    kinds = lambda c: F.size(F.array_distinct(F.col(f"cells.{c}")))
    good = cells.where((F.col("n") == F.size("cells")) & (F.size("cells") >= LEAST_WATERMARKS) & (kinds("col") >= 2) & (kinds("line") >= 3)).select(*keys).distinct()
    return enough.join(good, keys, "left_semi").select(*keys, "observation_id")
