"""Balloons: what blocks them, what they cover, and commands on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions.geometry import Box, Point, circle_meets_box, corners_inside_circle, intersect
from caliperlake.operators.ordered import gaps
from caliperlake.operators.spatial import PAGE, _starts, boxes_meeting, by_tables, meeting, page_pairs

# Fixed values, in points: radius of a balloon, inset and size of its number, widths and height of digits in units of that size.
RADIUS, INSET, FONT, DIGIT, LINE, LEAST_GLYPH = 12.0, 1.0, 9.0, 0.636, 1.164, 5.0
# Share of the page height where the form's administration strip begins; words of boxes that stay free; blockers in order.
STRIP, PROTECTED = 0.79, ("approved", "checked", "signature", "sign-off", "审核", "批准", "签字", "校对")
FLAGS = ("circle_overlap", "glyph_overlap", "glyph_circle_overlap", "owner_glyph_outside_circle", "outside_cropbox", "protected_overlap", "source_text_overlap", "unreadable_number", "invalid_leader")
BLOCKERS = (
    "missing_required_balloon", "item_balloon_disconnect", "manual_required", "unreadable_number", "outside_cropbox", "owner_glyph_outside_circle", "protected_overlap", "source_text_overlap",
    "invalid_leader", "circle_overlap", "glyph_overlap", "glyph_circle_overlap", "duplicate_or_gapped_number",
)


def glyph(number: Column, c: Point) -> Box:
    """Box of a number that is centred in its balloon."""
    w = F.greatest(F.lit(LEAST_GLYPH), F.length(number.cast("string")) * (DIGIT * FONT)) / 2
    h = F.lit(LINE * FONT / 2)
    return Box(c.x - w, c.y - h, c.x + w, c.y + h)


def _named(b: Box, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{n}": v for n, v in zip(("x0", "y0", "x1", "y1"), b, strict=True)}


def placed(balloons: DataFrame) -> DataFrame:
    """Balloons (cx, cy, formal_number) with the box of circle and number (x0 .. y1) and that of the number (g_x0 .. g_y1); a null number has none."""
    c = Point(F.col("cx"), F.col("cy"))
    g = glyph(F.col("formal_number"), c)
    wide = F.coalesce(F.greatest(F.lit(RADIUS), c.x - g.x0), F.lit(RADIUS))
    return balloons.withColumns({**_named(g, "g_"), "x0": c.x - wide, "y0": c.y - RADIUS, "x1": c.x + wide, "y1": c.y + RADIUS})


def covered_boxes(balloons: DataFrame, boxes: DataFrame) -> DataFrame:
    """Balloons and the boxes (page, box_id, x0 .. y1) that their circle or number meets."""
    own, g = placed(balloons), Box.of("g_")
    box = Box.of("r_")
    meets = circle_meets_box(Point(F.col("cx"), F.col("cy")), RADIUS, box) | F.coalesce(intersect(g, box), F.lit(False))
    pairs = page_pairs(own.select(*PAGE, "balloon_id", "cx", "cy", "x0", "y0", "x1", "y1", "g_x0", "g_y0", "g_x1", "g_y1"), boxes.select(*PAGE, "box_id", "x0", "y0", "x1", "y1"), meets)
    return pairs.select(*PAGE, "balloon_id", F.col("r_box_id").alias("box_id"))


def protected_boxes(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """The administration strip at the foot of each page, and the boxes of texts with a protected word."""
    said = F.exists(F.array(*(F.lit(t) for t in PROTECTED)), lambda t: F.instr(F.col("raw_text"), t) > 0)
    words = texts.where(said).select(*PAGE, F.col("observation_id").alias("box_id"), "x0", "y0", "x1", "y1")
    strip = pages.select(*PAGE, F.lit("strip").alias("box_id"), F.lit(0.0).alias("x0"), (F.col("height") * STRIP).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    return strip.unionByName(words)


def collisions(balloons: DataFrame) -> DataFrame:
    """Pairs of a page's balloons that collide: their circles, their numbers, or one's number with the other's circle."""
    own = placed(balloons.where("formal_number is not null"))
    a, b = Point(F.col("cx"), F.col("cy")), Point(F.col("r_cx"), F.col("r_cy"))
    circle = F.hypot(a.x - b.x, a.y - b.y) < 2 * RADIUS
    number = intersect(Box.of("g_"), Box.of("r_g_"))
    mixed = circle_meets_box(b, RADIUS, Box.of("g_")) | circle_meets_box(a, RADIUS, Box.of("r_g_"))
    pairs = page_pairs(own, own, (F.col("balloon_id") < F.col("r_balloon_id")) & (circle | number | mixed))
    return pairs.select(*PAGE, F.col("balloon_id").alias("left_id"), F.col("r_balloon_id").alias("right_id"), circle.alias("circle_overlap"), number.alias("glyph_overlap"), mixed.alias("glyph_circle_overlap"))


_OVERLAPS = ("text", "protected", "circle_overlap", "glyph_overlap", "glyph_circle_overlap")


def _into(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which balloons around (x, y) meet which boxes (n, 4), pair by pair."""
    return np.hypot(x - np.minimum(np.maximum(x, b[:, 0]), b[:, 2]), y - np.minimum(np.maximum(y, b[:, 1]), b[:, 3])) < RADIUS


def _overlap_flags(table: pa.Table) -> pa.Table:
    """The balloons of some pages with what each of them meets: texts, protected boxes, and other balloons in three ways."""
    numbers = lambda names: np.column_stack([table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names])
    kind = table.column("_kind").to_numpy()
    box, glyphs, centres = numbers(("x0", "y0", "x1", "y1")), numbers(("g_x0", "g_y0", "g_x1", "g_y1")), numbers(("cx", "cy"))
    page, node = np.cumsum(_starts(table, list(PAGE))) - 1, np.cumsum(_starts(table, [*PAGE, "balloon_id"])) - 1
    numbered = pc.fill_null(pc.greater_equal(table.column("formal_number"), 1), False).to_numpy()
    used = np.flatnonzero(np.isfinite(box).all(axis=1) & ((kind > 0) | numbered) & table.column("doc_id").is_valid().to_numpy() & table.column("page_index").is_valid().to_numpy())
    hits = np.zeros((len(_OVERLAPS), int(node[-1]) + 1 if len(node) else 0), bool)
    for left, right in boxes_meeting(box[used], page[used], meeting) if len(used) else ():
        a, b = used[left], used[right]
        a, b = np.where(kind[a] > 0, b, a), np.where(kind[a] > 0, a, b)  # the balloon first
        own = kind[a] == 0
        a, b = a[own], b[own]
        boxed = kind[b] > 0
        c, d = a[boxed], b[boxed]
        met = _into(*centres[c].T, box[d]) | meeting(glyphs[c], box[d])
        for k in (1, 2):
            hits[k - 1, node[c[met & (kind[d] == k)]]] = True
        pair = ~boxed & (node[a] != node[b])
        c, d = a[pair], b[pair]
        circle = np.hypot(centres[c, 0] - centres[d, 0], centres[c, 1] - centres[d, 1]) < 2 * RADIUS
        mixed = _into(*centres[d].T, glyphs[c]) | _into(*centres[c].T, glyphs[d])
        for k, met in enumerate((circle, meeting(glyphs[c], glyphs[d]), mixed), 2):
            hits[k, node[c[met]]] = hits[k, node[d[met]]] = True
    balloons = np.flatnonzero(kind == 0)
    out = table.take(pa.array(balloons)).drop_columns(["_kind"])
    for name, hit in zip(_OVERLAPS, hits, strict=True):
        out = out.append_column(f"_{name}", pa.array(hit[node[balloons]]))
    return out


def with_overlaps(own: DataFrame, texts: DataFrame, protected: DataFrame) -> DataFrame:
    """Placed balloons with flags of what they meet; those without a number of at least 1 meet nothing.  Balloons and boxes come once, by page, and their pairs are never rows of a table."""
    of_kind = lambda df, k: df.select(*PAGE, "x0", "y0", "x1", "y1", F.lit(k).alias("_kind"))
    rows = own.withColumn("_kind", F.lit(0)).unionByName(of_kind(texts, 1), allowMissingColumns=True).unionByName(of_kind(protected, 2), allowMissingColumns=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return by_tables(rows, list(PAGE), ["balloon_id"], _overlap_flags, schema + "".join(f", _{name} boolean" for name in _OVERLAPS))


def findings(items: DataFrame, balloons: DataFrame, texts: DataFrame, protected: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, balloon_id and codes, in the order of the blockers, of every active balloon.

    items (doc_id, item_id, active, required, source_ids), balloons (page, balloon_id, item_id, source_id, status, placement_status,
    formal_number, cx, cy, anchor x0 .. y1 as a_x0 .., target tx, ty, flags), pages (page, width, height).
    """
    live = balloons.where("status = 'active'")
    owner = items.where("active").select("doc_id", "item_id", F.col("required").alias("_required"), F.col("source_ids").alias("_sources"))
    kinds = ("circle_overlap", "glyph_overlap", "glyph_circle_overlap")
    c = Point(F.col("cx"), F.col("cy"))
    target = (F.col("tx") >= F.col("a_x0")) & (F.col("tx") <= F.col("a_x1")) & (F.col("ty") >= F.col("a_y0")) & (F.col("ty") <= F.col("a_y1")) & ((F.col("tx") != c.x) | (F.col("ty") != c.y))
    # What a balloon tells by itself is worked out first, so that rows are narrow when they are shuffled.
    alone = placed(live).withColumns({"_manual": F.col("placement_status") == "manual_required", "_readable": corners_inside_circle(Box.of("g_"), c, RADIUS - INSET), "_target": target})
    kept = [*PAGE, "balloon_id", "item_id", "source_id", "formal_number", "cx", "cy", "flags", "_manual", "_readable", "_target"]
    boxes = [f"{p}{e}" for p in ("", "g_") for e in ("x0", "y0", "x1", "y1")]
    df = with_overlaps(alone.select(*kept, *boxes), texts, protected).drop(*boxes)
    df = df.join(pages.select(*PAGE, "width", "height"), list(PAGE), "left")
    inside = (c.x >= 0) & (c.y >= 0) & (c.x <= F.col("width")) & (c.y <= F.col("height"))
    df = df.withColumns({"_inside": inside, "_good": F.coalesce(F.col("formal_number") >= 1, F.lit(False))}).drop("cx", "cy", "width", "height", "formal_number", "page_index")
    df = df.join(owner, ["doc_id", "item_id"], "left")
    inside, good, readable, target = F.col("_inside"), F.col("_good"), F.col("_readable"), F.col("_target")
    stored = lambda name: F.array_contains("flags", name)
    own = {
        "item_balloon_disconnect": F.col("_required").isNull() | ~F.col("_required") | ~F.array_contains("_sources", F.col("source_id")),
        "manual_required": F.col("_manual"),
        "unreadable_number": ~good | ~readable,
        "outside_cropbox": ~inside,
        "owner_glyph_outside_circle": good & ~readable,
        "protected_overlap": F.col("_protected"),
        "source_text_overlap": F.coalesce(F.col("_text"), F.lit(False)) | stored("forbidden_overlap"),
        "invalid_leader": ~target,
        **{k: F.col(f"_{k}") for k in kinds},
    }
    codes = [F.when(F.coalesce(own[b], F.lit(False)) | (F.coalesce(stored(b), F.lit(False)) if b in FLAGS else F.lit(False)), b) for b in BLOCKERS if b in own]
    return df.select("doc_id", "balloon_id", F.array_compact(F.array(*codes)).alias("codes"))


def blockers(items: DataFrame, balloons: DataFrame, found: DataFrame) -> DataFrame:
    """All blockers of each document, in order: those of its balloons, required items without one, and numbers that are not 1 .. n."""
    live = balloons.where("status = 'active'")
    required = items.where("active and required").select("doc_id", "item_id").distinct()
    missing = required.join(live.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").select("doc_id", F.lit("missing_required_balloon").alias("code"))
    numbers = gaps(live.select("doc_id", "formal_number"), "doc_id", "formal_number")
    wrong = numbers.where(~F.coalesce("contiguous", F.lit(False))).select("doc_id", F.lit("duplicate_or_gapped_number").alias("code"))
    # bool_and passes over nulls, so balloons without a number are told apart here.
    unnumbered = live.where("formal_number is null").select("doc_id", F.lit("duplicate_or_gapped_number").alias("code"))
    said = found.select("doc_id", F.explode("codes").alias("code")).unionByName(missing).unionByName(wrong).unionByName(unnumbered)
    sets = said.groupBy("doc_id").agg(F.collect_set("code").alias("codes"))  # thirteen codes at most
    docs = items.select("doc_id").distinct().join(sets, "doc_id", "left")
    ordered = F.array(*(F.when(F.array_contains("codes", b), b) for b in BLOCKERS))
    return docs.select("doc_id", F.array_join(F.array_compact(ordered), ",").alias("blockers"))


def set_differences(items: DataFrame, balloons: DataFrame) -> DataFrame:
    """Of each document, how many required items lack an active balloon and how many active balloons lack a required item, and whether the sets are equal."""
    need = items.where("active and required").select("doc_id", "item_id").distinct().withColumn("_i", F.lit(1))
    have = balloons.where("status = 'active'").select("doc_id", "item_id").distinct().withColumn("_b", F.lit(1))
    both = need.join(have, ["doc_id", "item_id"], "full_outer").groupBy("doc_id").agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_i").isNull()).alias("unexpected"))
    return both.withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def renumbered(balloons: DataFrame, order: DataFrame) -> DataFrame:
    """Numbers from a list of balloon ids (doc_id, position, balloon_id), if it names every active balloon once and nothing else; else the reason against it."""
    live = balloons.where("status = 'active'").select("doc_id", "balloon_id")
    listed = order.groupBy("doc_id", "balloon_id").agg(F.count("*").alias("times"), F.min("position").alias("position"))
    both = live.withColumn("_live", F.lit(True)).join(listed, ["doc_id", "balloon_id"], "full_outer")
    w = Window.partitionBy("doc_id")
    reason = F.when(F.max("times").over(w) > 1, "not_distinct").when(F.count_if(F.col("_live").isNull() | F.col("times").isNull()).over(w) > 0, "not_the_active_set")
    return both.where("_live or times is not null").withColumn("reason", reason).select(
        "doc_id", "balloon_id", F.when(F.col("reason").isNull(), F.row_number().over(w.orderBy("position", "balloon_id"))).alias("number"), "reason", F.col("_live").isNotNull().alias("live")
    ).where("live").drop("live")


def after_commands(balloons: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Balloons after their commands (balloon_id, version, kind: move, delete, rebuild or reorder, cx, cy, sort_order), and documents whose numbers are stale.

    Each field takes its last writer; a rebuilt balloon loses its number where another active one has it.
    """
    stamp = F.col("version")
    last = lambda value, *kinds: F.max_by(value, F.when(F.col("kind").isin(*kinds), stamp))
    state = F.when(F.col("kind") == "delete", "deleted").when(F.col("kind") == "rebuild", "active")
    folded = commands.groupBy("doc_id", "balloon_id").agg(
        last(F.struct("cx", "cy"), "move", "rebuild").alias("_at"), last(state, "delete", "rebuild").alias("_state"), last(F.col("sort_order"), "reorder").alias("_sort"), F.count("*").alias("_n"),
        F.bool_or(F.col("kind") == "reorder").alias("_reordered"), F.bool_or(F.col("kind") == "rebuild").alias("_rebuilt"),
    )
    df = balloons.join(folded, ["doc_id", "balloon_id"], "left")
    df = df.withColumns({"status": F.coalesce("_state", "status"), "cx": F.coalesce("_at.cx", "cx"), "cy": F.coalesce("_at.cy", "cy"), "sort_order": F.coalesce("_sort", "sort_order"), "version": F.col("version") + F.coalesce("_n", F.lit(0))})
    w = Window.partitionBy("doc_id", "formal_number")
    taken = (F.count_if((F.col("status") == "active") & ~F.coalesce("_rebuilt", F.lit(False))).over(w) > 0) & F.col("formal_number").isNotNull()
    reused = F.coalesce("_rebuilt", F.lit(False)) & (F.col("status") == "active") & (taken | F.col("formal_number").isNull())
    df = df.withColumn("_reused", reused).withColumn("formal_number", F.when(F.col("_reused"), F.lit(None)).otherwise(F.col("formal_number")))
    stale = df.groupBy("doc_id").agg(F.bool_or(F.col("_reused") | F.coalesce("_reordered", F.lit(False))).alias("numbering_stale"))
    return df.select("doc_id", "balloon_id", "status", "cx", "cy", "sort_order", "formal_number", "version"), stale


def listed_items(items: DataFrame, balloons: DataFrame) -> DataFrame:
    """Items with their balloon, and their place in the list: numbered ones first, by number."""
    live = balloons.where("status <> 'deleted'").select("doc_id", "item_id", "balloon_id", "formal_number")
    both = items.join(live, ["doc_id", "item_id"], "left")
    order = [F.col("formal_number").asc_nulls_last(), F.col("item_id"), F.col("balloon_id")]
    return both.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def candidate_numbers(items: DataFrame, order: str) -> DataFrame:
    """Numbers of active items in list order."""
    return items.where("active").withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
