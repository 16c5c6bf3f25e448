"""Tolerance frames: axis segments of drawings, frames from pairs of lines, their texts, and checks of recognised frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions import tolerances as T
from caliperlake.functions.geometry import Box, area, centre, expanded, in_padded_frame
from caliperlake.operators.spatial import PAGE, by_tables
from caliperlake.scratch import written

# Fixed values, in points: tolerance of an axis, gap that is bridged, limits of a frame, padding around it.
AXIS, GAP = 0.25, 1.5
LEAST_HEIGHT, MOST_HEIGHT, LEAST_WIDTH, MOST_WIDTH, PADDING = 6.0, 48.0, 12.0, 240.0, 1.5


def axis_segments(items: DataFrame) -> DataFrame:
    """Path items (op, ax, ay, bx, by) -> horizontal and vertical segments; a rectangle gives its four edges, all else is left out."""
    line = lambda *c: F.struct(*(F.col(x).alias(n) for x, n in zip(c, ("ax", "ay", "bx", "by"), strict=True)))
    edges = F.array(line("ax", "ay", "bx", "ay"), line("bx", "ay", "bx", "by"), line("bx", "by", "ax", "by"), line("ax", "by", "ax", "ay"))
    lines = F.when(F.col("op") == "l", F.array(line("ax", "ay", "bx", "by"))).when((F.col("op") == "re") & (F.col("ax") <= F.col("bx")) & (F.col("ay") <= F.col("by")), edges)
    each = items.select(*PAGE, F.explode(lines).alias("s")).select(*PAGE, "s.*")
    flat = (F.abs(F.col("by") - F.col("ay")) <= AXIS) & (F.abs(F.col("bx") - F.col("ax")) > AXIS)
    steep = (F.abs(F.col("bx") - F.col("ax")) <= AXIS) & (F.abs(F.col("by") - F.col("ay")) > AXIS)
    pick = lambda a, b: F.when(flat, a).otherwise(b)
    return each.where(flat | steep).select(
        *PAGE,
        pick(F.lit("horizontal"), F.lit("vertical")).alias("orientation"),
        pick((F.col("ay") + F.col("by")) / 2, (F.col("ax") + F.col("bx")) / 2).alias("coordinate"),
        pick(F.least("ax", "bx"), F.least("ay", "by")).alias("start"),
        pick(F.greatest("ax", "bx"), F.greatest("ay", "by")).alias("end"),
    )


def _stepwise(first: np.ndarray, last: np.ndarray, c: np.ndarray, s: np.ndarray, e: np.ndarray, begins: np.ndarray, runs: tuple[np.ndarray, ...]) -> None:
    """Joins the segments of each group [first, last) step by step, a step of all groups at once: marks where runs begin and fills in their coordinate, start and end there."""
    at, low, high = runs
    began, group = first.copy(), np.arange(len(first))
    begins[first] = True
    x, y, z = (v[first].astype(float) for v in (c, s, e))
    step = 0
    while True:
        step += 1
        going = first[group] + step < last[group]
        if not going.all():
            done = ~going
            at[began[done]], low[began[done]], high[began[done]] = x[done], y[done], z[done]
            group, began, x, y, z = group[going], began[going], x[going], y[going], z[going]
        if not len(group):
            return
        k = first[group] + step
        joins = (np.abs(x - c[k]) <= AXIS) & (s[k] <= z + GAP)
        ended = ~joins
        at[began[ended]], low[began[ended]], high[began[ended]] = x[ended], y[ended], z[ended]
        begins[k] = ended
        began = np.where(joins, began, k)
        x = np.where(joins, (x + c[k]) / 2.0, c[k])
        y = np.where(joins & ~(s[k] < y), y, s[k])
        z = np.where(joins & ~(e[k] > z), z, e[k])


_FEW = 64  # groups for which a step of all at once is no gain


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of sorted segments of one page and orientation; the coordinate is averaged step by step, so the order counts.  Only the open run is held, over batches too.

    Segments of one coordinate with no other near it are cut into runs as arrays; the average stays what it is there.  All others are joined step by step.
    """
    names = [*PAGE, "orientation", "coordinate", "start", "end"]
    frame = lambda key, at, low, high: pd.DataFrame(dict(zip(names, (*key, at, low, high), strict=True)))
    going: tuple | None = None  # key, coordinate, start and end of the open run
    for pdf in batches:
        n = len(pdf)
        if not n:
            continue
        *key, c, s, e = (pdf[k].to_numpy() for k in names)
        apart = np.ones(n, bool)  # no run goes on here
        apart[1:] = ~(np.abs(c[1:] - c[:-1]) <= AXIS)
        for k in key:
            apart[1:] |= k[1:] != k[:-1]
        stepwise = ~(np.isfinite(2 * c) & np.isfinite(s) & np.isfinite(e))
        stepwise[1:] |= ~apart[1:] & ((c[1:] != c[:-1]) | (s[1:] < s[:-1]))
        first = np.flatnonzero(apart)
        stepwise = np.logical_or.reduceat(stepwise, first)
        stepwise[0] |= going is not None
        ends, rank = np.unique(e, return_inverse=True)
        reach = ends[np.maximum.accumulate((np.cumsum(apart) - 1) * len(ends) + rank) % len(ends)]
        begins = apart.copy()
        begins[1:] |= ~(s[1:] <= reach[:-1] + GAP)
        at, low, high = c.astype(float), s.astype(float), e.astype(float)
        last = np.append(first[1:], n)
        made = []  # runs that were joined one by one: where they begin, coordinate, start and end
        firsts, lasts = first[stepwise], last[stepwise]
        size = np.sort(lasts - firsts)[::-1]
        longest = int(size[_FEW]) if len(size) > _FEW else 0  # so each step has more than a few groups
        alone = lasts - firsts > longest
        if going is not None:
            alone[0] = True
        together = ()
        if not alone.all():
            together = (firsts[~alone], lasts[~alone])
            for a, b in zip(*together, strict=True):
                begins[a:b] = False
        for a, b in zip(firsts[alone].tolist(), lasts[alone].tolist(), strict=True):
            run = going if a == 0 and going is not None and going[0] == tuple(k[0] for k in key) else None
            where, begins[a:b] = None, False
            for i, x, y, z in zip(range(a, b), c[a:b].tolist(), s[a:b].tolist(), e[a:b].tolist(), strict=True):
                if run is not None and abs(run[1] - x) <= AXIS and y <= run[3] + GAP:
                    run = (run[0], (run[1] + x) / 2.0, min(run[2], y), max(run[3], z))
                    continue
                if where is not None:
                    made.append((where, *run[1:]))
                elif run is not None:
                    going = run
                where, run, begins[i] = i, (None, x, y, z), True
            if where is not None:
                made.append((where, *run[1:]))
            else:
                going = run
        filled = at.copy(), low.copy(), high.copy()
        if together:
            _stepwise(*together, c, s, e, begins, filled)
        rows = np.flatnonzero(begins)
        if not len(rows):
            continue
        high[rows] = np.maximum.reduceat(e, rows)
        if together:
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, together[0], 1)
            np.add.at(inside, together[1], -1)
            inside = np.cumsum(inside[:-1]) > 0
            mine = rows[inside[rows]]
            at[mine], low[mine], high[mine] = (v[mine] for v in filled)
        for where, *run in made:
            at[where], low[where], high[where] = run
        if going is not None:
            yield frame([[k] for k in going[0]], *([v] for v in going[1:]))
        done, i = rows[:-1], rows[-1]
        going = (tuple(k[i] for k in key), float(at[i]), float(low[i]), float(high[i]))
        if len(done):
            yield frame([k[done] for k in key], at[done], low[done], high[done])
    if going is not None:
        yield frame([[k] for k in going[0]], *([v] for v in going[1:]))


def joined_segments(segments: DataFrame) -> DataFrame:
    """Collinear segments that touch, or nearly so, as one; segments stream through sorted partitions, so a task holds one run at a time.

    They are dealt and sorted with a boolean in place of the orientation's name.
    """
    schema = "doc_id bigint, page_index int, orientation boolean, coordinate double, start double, end double"
    flat = (F.col("orientation") == "horizontal").alias("orientation")
    keys = [*PAGE, "orientation"]
    rows = segments.select(*PAGE, flat, "coordinate", "start", "end").repartition(*keys).sortWithinPartitions(*keys, "coordinate", "start", "end")
    name = F.when(F.col("orientation"), "horizontal").otherwise("vertical")
    return rows.mapInPandas(_runs, schema).withColumn("orientation", name)


def deduped_positions(positions: Column) -> Column:
    """Sorted positions, where each one within the axis tolerance of the last kept is averaged into it."""

    def step(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = last.isNull() | (p - last > AXIS)
        return F.when(apart, F.concat(kept, F.array(p))).otherwise(F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array((last + p) / 2)))

    return F.aggregate(F.array_sort(positions), F.array().cast("array<double>"), step)


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ranges: which range each is of, and its place."""
    of = np.repeat(np.arange(len(count)), count)
    return of, begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _coded(*sides: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """(page, value) of several tables as whole numbers of one order."""
    known, rank = np.unique(np.concatenate([v for _, v in sides]), return_inverse=True)
    cuts = np.cumsum([len(v) for _, v in sides])[:-1]
    return [page * len(known) + r for (page, _), r in zip(sides, np.split(rank, cuts), strict=True)]


def _blocks(size: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about _STEP in size; rows of one number in ``whole`` (sorted) stay together."""
    starts = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
    before = np.cumsum(size) - size
    step = before[starts] // _STEP
    cut = np.append(starts[np.append(True, step[1:] != step[:-1])], len(whole)) if len(starts) else np.zeros(1, np.int64)
    yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


_STEP, _CELL = 1 << 19, 64.0  # rows looked at in one step, side of a grid cell
_FRAME = "doc_id bigint, page_index int, x0 double, y0 double, x1 double, y1 double, cells array<double>"


def _framed(table: pa.Table) -> pa.Table:
    """Frames of the pages of a table of sorted segments.

    A frame's verticals end at its two horizontals, so pairs of horizontals are those that verticals name, and a vertical that goes beyond a pair is found by the farthest end of those that begin before it.
    """
    out = pa.schema([("doc_id", pa.int64()), ("page_index", pa.int32()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1")), ("cells", pa.list_(pa.float64()))])
    runs = pd.concat(list(_runs(iter([table.to_pandas()]))))
    doc, number, flat = (runs[k].to_numpy() for k in (*PAGE, "orientation"))
    page = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]))) - 1
    first = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    c = runs["coordinate"].to_numpy()
    s, e = (np.where(np.isnan(v), np.inf, v) for v in (runs["start"].to_numpy(), runs["end"].to_numpy()))  # as in SQL, no number is above all
    flat = flat.astype(bool)
    by_place = lambda rows, v: rows[np.lexsort((v[rows], page[rows]))]
    h, v = by_place(np.flatnonzero(flat), c), by_place(np.flatnonzero(~flat), s)
    if not len(h) or not len(v):
        return out.empty_table()

    # Levels: the different coordinates of a page's horizontals.
    fresh = np.flatnonzero(np.append(True, (page[h[1:]] != page[h[:-1]]) | (c[h[1:]] != c[h[:-1]])))
    until = np.append(fresh[1:], len(h))
    on, y = page[h[fresh]], c[h[fresh]]
    low, high = y - AXIS, y + AXIS
    low_key, high_key, y_key, begin_key, end_key = _coded((on, low), (on, high), (on, y), (page[v], s[v]), (page[v], e[v]))
    known, rank = np.unique(e[v], return_inverse=True)
    reach = known[np.maximum.accumulate(page[v] * len(known) + rank) % len(known)]  # the farthest end of a page's verticals so far
    page_begin = np.searchsorted(page[v], on)

    # Each vertical with the levels at which it begins, and those at which it ends.
    near = np.flatnonzero((e[v] - s[v] >= LEAST_HEIGHT - 3 * AXIS) & (e[v] - s[v] <= MOST_HEIGHT + 3 * AXIS))
    levels = lambda key: (np.searchsorted(high_key, key), np.searchsorted(low_key, key, "right"))
    (top, top_end), (bottom, bottom_end) = levels(begin_key[near]), levels(end_key[near])
    some = (top < top_end) & (bottom < bottom_end)
    near, top, top_end, bottom, bottom_end = (a[some] for a in (near, top, top_end, bottom, bottom_end))
    of, t = _spread(top, top_end - top)
    order = np.argsort(t, kind="stable")
    of, t = of[order], t[order]
    wide = (bottom_end - bottom)[of]
    parts = []
    for a, b in _blocks(wide, t):
        each, level = _spread(bottom[of[a:b]], wide[a:b])
        above, line = t[a:b][each], v[near[of[a:b][each]]]
        tall = y[level] - y[above]
        fits = (tall >= LEAST_HEIGHT) & (tall <= MOST_HEIGHT)
        above, level, line = above[fits], level[fits], line[fits]
        order = np.lexsort((c[line], level, above))
        above, level, x = above[order], level[order], c[line[order]]
        parts += _cells(above, level, x, on, low_key, high_key, begin_key, page_begin, reach, low, high)
    if not parts:
        return out.empty_table()
    above, level, sizes, cells = (np.concatenate(q) for q in zip(*parts, strict=True))
    x0, x1 = cells[np.cumsum(sizes) - sizes], cells[np.cumsum(sizes) - 1]

    # Full lines: those of the pair, and no third.
    begin, end = fresh[np.searchsorted(y_key, low_key[above])], until[np.searchsorted(y_key, high_key[level], "right") - 1]
    kept = np.zeros(len(above), bool)
    for a, b in _blocks(end - begin, np.arange(len(above))):
        each, row = _spread(begin[a:b], (end - begin)[a:b])
        row = h[row]
        covers = (s[row] <= x0[a:b][each] + AXIS) & (e[row] >= x1[a:b][each] - AXIS)
        count = lambda hit: np.bincount(each[hit], minlength=b - a)  # noqa: E731, B023
        kept[a:b] = (count(covers) == 2) & (count(covers & (c[row] == y[above[a:b]][each])) > 0) & (count(covers & (c[row] == y[level[a:b]][each])) > 0)
    above, level, x0, x1, cells, sizes = above[kept], level[kept], x0[kept], x1[kept], cells[np.repeat(kept, sizes)], sizes[kept]
    row = first[on[above]]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(cells))
    return pa.Table.from_arrays([pa.array(doc[row].astype(np.int64)), pa.array(number[row].astype(np.int32)), *(pa.array(q) for q in (x0, y[above], x1, y[level])), lists], schema=out)


def _cells(above, level, x, on, low_key, high_key, begin_key, page_begin, reach, low, high) -> list[tuple[np.ndarray, ...]]:
    """Pairs of levels (sorted, with the positions of their verticals) that no vertical goes beyond, and the edges of their cells: [(above, level, sizes, cells)], if there are any."""
    if not len(above):
        return []
    first = np.flatnonzero(np.append(True, (above[1:] != above[:-1]) | (level[1:] != level[:-1])))
    sizes = np.diff(np.append(first, len(above)))
    t, b = above[first], level[first]
    farthest = lambda last: np.where(last >= page_begin[t], reach[np.maximum(last, 0)], -np.inf)
    beyond = farthest(np.searchsorted(begin_key, high_key[t], "right") - 1) > high[b]
    beyond |= farthest(np.searchsorted(begin_key, low_key[t]) - 1) >= low[b]
    good = (sizes >= 3) & ~beyond
    x, sizes, t, b = x[np.repeat(good, sizes)], sizes[good], t[good], b[good]
    if not len(t):
        return []
    first = np.cumsum(sizes) - sizes
    gap = np.append(np.inf, x[1:] - x[:-1])
    gap[first] = np.inf
    kept = gap > 0
    close = np.add.reduceat((gap > 0) & (gap <= AXIS), first) > 0
    for k in np.flatnonzero(close).tolist():  # positions that are averaged, one after the other
        positions: list[float] = []
        for p in x[first[k] : first[k] + sizes[k]].tolist():
            if positions and not p - positions[-1] > AXIS:
                positions[-1] = (positions[-1] + p) / 2
            else:
                positions.append(p)
        kept[first[k] : first[k] + sizes[k]] = False
        kept[first[k] : first[k] + len(positions)] = True
        x[first[k] : first[k] + len(positions)] = positions
    sizes, cells = np.add.reduceat(kept.astype(np.int64), first), x[kept]
    last = np.cumsum(sizes) - 1
    width = cells[last] - cells[last - sizes + 1]
    good = (sizes >= 3) & (width >= LEAST_WIDTH) & (width <= MOST_WIDTH)
    return [(t[good], b[good], sizes[good], cells[np.repeat(good, sizes)])] if good.any() else []


def frames(segments: DataFrame) -> DataFrame:
    """Frames of a page, from its axis segments: two horizontals at a frame's distance, at least three verticals from one to the other, and no third full-width line.

    Segments are dealt by page and joined where their frames are found, so neither joined lines nor pairs of them are rows of a table; a task holds some pages at a time.  The frames are written once for all that read them.
    """
    flat = (F.col("orientation") == "horizontal").alias("orientation")
    rows = segments.where(F.col("doc_id").isNotNull() & F.col("page_index").isNotNull()).select(*PAGE, flat, "coordinate", "start", "end")
    found = by_tables(rows, list(PAGE), ["orientation", "coordinate", "start", "end"], _framed, _FRAME)
    mils = F.transform(F.concat(F.array("x0", "y0", "x1", "y1"), "cells"), lambda v: F.round(v * 1000).cast("bigint").cast("string"))
    ident = F.substring(F.sha2(F.concat_ws(":", "page_index", F.array_join(mils, ",")), 256), 1, 24)
    return written(found.select(*PAGE, "x0", "y0", "x1", "y1", "cells", ident.alias("frame_id")), "frames")


def frame_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts in each frame, with the cell that each one's centre is in and its place in the frame's order.

    A text that is half in a frame has its centre there, so texts are dealt once, to the grid cell of their centre, and frames to all cells that they and a point around them cover.
    """
    edges = ("x0", "y0", "x1", "y1")
    wide = expanded(Box.of(), PADDING)
    padded = found.select(*PAGE, "frame_id", "cells", *(v.alias(n) for v, n in zip(wide, edges, strict=True)))
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - 1) / _CELL), F.floor((F.col(hi) + 1) / _CELL)))
    padded = padded.withColumn("_gx", span("x0", "x1")).withColumn("_gy", span("y0", "y1"))
    text = Box.of("r_")
    middle = centre(text)
    c = middle.x
    right = texts.select(*(F.col(k).alias(f"r_{k}") for k in (*PAGE, "observation_id", *edges))).where(area(text) > 0)
    on = [F.col(k) == F.col(f"r_{k}") for k in PAGE] + [F.col("_gx") == F.floor(middle.x / _CELL), F.col("_gy") == F.floor(middle.y / _CELL)]
    pairs = padded.join(right, [*on, in_padded_frame(text, Box.of())])
    cell = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(0), F.size("cells") - 2), lambda i: c <= F.element_at("cells", (i + 2).cast("int"))), F.lit(1)), F.size("cells") - 2)
    rows = pairs.select(*PAGE, "frame_id", F.col("r_observation_id").alias("text_id"), cell.cast("int").alias("cell"), F.col("r_y0").alias("ty"), F.col("r_x0").alias("tx"))
    place = F.row_number().over(Window.partitionBy(*PAGE, "frame_id").orderBy("cell", "ty", "tx", "text_id"))
    return rows.select(*PAGE, "frame_id", "text_id", "cell", place.alias("place"))


def without_administrative(found: DataFrame, placed: DataFrame, administrative: DataFrame) -> DataFrame:
    """Frames none of whose texts (page, frame_id, text_id) is among administrative ones (doc_id, text_id)."""
    bad = placed.join(administrative.select("doc_id", "text_id"), ["doc_id", "text_id"], "left_semi").select(*PAGE, "frame_id").distinct()
    return found.join(bad, [*PAGE, "frame_id"], "left_anti")


def tolerance_segments(evidence: DataFrame) -> DataFrame:
    """Rows with cells (array of role, token) and signal -> the same with code, tolerance_type, value, diameter, modifiers, datums.

    Cells are read in a generator of one row: a filter on what they say would else be pushed below it, and read them once more.
    """
    keep = [c for c in evidence.columns if c not in ("cells", "signal")]
    return evidence.select(*keep, F.inline(F.array(T.segment(F.col("cells"), F.col("signal")))))


def tolerance_texts(segments: DataFrame, key: str, order: str) -> DataFrame:
    """Segments of a frame in order -> one row: the first code of any, or a conflict of types; else its drawing text and its sheet text."""
    s = F.struct("value", "diameter", "modifiers", "datums")
    each = segments.select("doc_id", key, order, "code", "tolerance_type", T.segment_text(s).alias("text"), T.sheet_segment_text(s).alias("sheet"))
    rows = each.groupBy("doc_id", key).agg(F.array_sort(F.collect_list(F.struct(order, "code", "tolerance_type", "text", "sheet"))).alias("rows"))
    codes = F.transform("rows", lambda r, i: F.coalesce(r["code"], F.when(F.exists(F.slice("rows", F.lit(1), i), lambda q: q["tolerance_type"] != r["tolerance_type"]), "gdt_projection_conflict")))
    code = F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(1))
    kind = F.element_at("rows", 1)["tolerance_type"]
    joined = lambda f: F.array_join(F.transform("rows", lambda r: r[f]), " / ")
    good = code.isNull()
    return rows.select(
        "doc_id", key, code.alias("code"), F.when(good, kind).alias("tolerance_type"), F.when(good, F.concat(T.symbol_of(kind), F.lit(" | "), joined("text"))).alias("normalized_text"), F.when(good, F.concat(T.label_of(kind), F.lit(" | "), joined("sheet"))).alias("sheet_text")
    )


def envelope_code(stored: DataFrame) -> Column:
    """What a stored tolerance has that does not follow from its first segment and type; null if all of it does."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return (
        F.when(~F.col("symbol").eqNullSafe(T.symbol_of(F.col("tolerance_type"))), "tolerance_symbol")
        .when(~same("stored_value", "value"), "tolerance_value")
        .when(~same("stored_diameter", "diameter"), "diameter_modifier")
        .when(~same("stored_modifiers", "modifiers"), "modifiers")
        .when(~same("stored_datums", "datums"), "datum_references")
        .when(~same("stored_text", "normalized_text"), "normalized_text")
    )


def _contains(outer: Box, inner: Box, by: float = 0.01) -> Column:
    return (inner.x0 >= outer.x0 - by) & (inner.y0 >= outer.y0 - by) & (inner.x1 <= outer.x1 + by) & (inner.y1 <= outer.y1 + by)


def _box(s: Column) -> Box:
    return Box(s["x0"], s["y0"], s["x1"], s["y1"])


def page_box(unit: Box, crop: Box) -> Box:
    """A box in shares of a crop -> in points of the page."""
    w, h = crop.x1 - crop.x0, crop.y1 - crop.y0
    return Box(crop.x0 + unit.x0 * w, crop.y0 + unit.y0 * h, crop.x0 + unit.x1 * w, crop.y0 + unit.y1 * h)


def _unit(b: Box) -> Column:
    ranged = [(v >= 0) & (v <= 1) for v in b]
    return ranged[0] & ranged[1] & ranged[2] & ranged[3] & (b.x1 > b.x0) & (b.y1 > b.y0)


def evidence_code(found: Column, evidence: Column, proposal: Column, crop: Column) -> Column:
    """The first rule that a recognised frame breaks against its local proposal; null if none.

    evidence: struct (box, cells: index, box, role, token, text_ids), boxes in shares of the crop; proposal: struct (box, cells: box, text_ids), in points.
    """
    c = _box(crop)
    frame = page_box(_box(evidence["box"]), c)
    cells = evidence["cells"]

    def cell_code(e: Column, i: Column) -> Column:
        at, token = page_box(_box(e["box"]), c), F.trim(e["token"])
        own = F.try_element_at(proposal["cells"], (i + 1).cast("int"))
        return (
            F.when(~_unit(_box(e["box"])), "cell_bbox_invalid")
            .when(~_contains(frame, at), "cell_bbox_out_of_frame")
            .when(~_contains(_box(own), at), "cell_bbox_mismatch")
            .when(F.size(F.array_except(e["text_ids"], proposal["text_ids"])) > 0, "text_id_not_allowlisted")
            .when(e["role"].isin("datum", "modifier") & ((token == "") | token.rlike(r"\s")), "cell_token_invalid")
        )

    first_bad = F.try_element_at(F.filter(F.transform(cells, cell_code), lambda x: x.isNotNull()), F.lit(1))
    ordered = F.forall(F.transform(cells, lambda e, i: e["index"] == i), lambda ok: ok)
    return (
        F.when(~found, "frame_id_not_found")
        .when((c.x1 <= c.x0) | (c.y1 <= c.y0), "crop_bbox_invalid")
        .when(~_unit(_box(evidence["box"])), "frame_bbox_invalid")
        .when(~_contains(c, frame) | ~_contains(_box(proposal["box"]), frame), "frame_bbox_out_of_bounds")
        .when(~ordered, "cell_index_not_contiguous")
        .when(F.size(cells) != F.size(proposal["cells"]), "cell_count_mismatch")
        .otherwise(first_bad)
    )
