"""Page layout: items near a text, roles of places, values beside labels, greedy choices in reading order.

The placements are order-dependent within a page, so a page is one group with an index of its own; all else is joins and windows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions.geometry import Box, axis_gaps, centre, interval_overlap, iou
from caliperlake.operators.balloons import DIGIT, FONT, INSET, LINE
from caliperlake.operators.spatial import PAGE, _starts, by_tables, page_pairs
from caliperlake.scratch import written


def items_near(texts: DataFrame, items: DataFrame, gap: float = 12.0, largest: float = 96.0) -> DataFrame:
    """Items at most ``gap`` away from a text on both axes, and not larger than a limit."""
    small = items.where((F.col("x1") - F.col("x0") <= largest) & (F.col("y1") - F.col("y0") <= largest))
    wide = texts.select(*PAGE, "observation_id", (F.col("x0") - gap).alias("x0"), (F.col("y0") - gap).alias("y0"), (F.col("x1") + gap).alias("x1"), (F.col("y1") + gap).alias("y1"))
    apart = axis_gaps(Box.of(), Box.of("r_"))
    pairs = page_pairs(wide, small.select(*PAGE, "observation_id", "x0", "y0", "x1", "y1"), (apart.x == 0) & (apart.y == 0))
    return pairs.select(*PAGE, F.col("observation_id").alias("text_id"), F.col("r_observation_id").alias("item_id"))


def roles_of(obs: DataFrame, roles: DataFrame) -> DataFrame:
    """The role whose rectangle holds a text's centre; several make it ambiguous, none leaves it out.  Roles are a fixed table."""
    c = centre(Box.of())
    inside = (c.x >= F.col("rx0")) & (c.x <= F.col("rx1")) & (c.y >= F.col("ry0")) & (c.y <= F.col("ry1"))
    hit = obs.join(F.broadcast(roles), inside)
    return hit.groupBy("doc_id", "observation_id").agg(F.count("*").alias("n"), F.min("role").alias("role")).select("doc_id", "observation_id", F.when(F.col("n") == 1, F.col("role")).otherwise("ambiguous").alias("role"))


def values_beside(labels: DataFrame, values: DataFrame, least: float = 0.5, band: float = 32.0) -> DataFrame:
    """For each label the one value to its right in the same row; two and more make it ambiguous.

    Rows meet in horizontal bands, and a pair is made in the band where both have begun, so a page is no nested loop.
    """
    rows = lambda df, p: df.withColumn("_band", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / band), F.floor(F.col(f"{p}y1") / band))))
    right = values.select(*PAGE, *(F.col(c).alias(f"v_{c}") for c in ("observation_id", "raw_text", "x0", "y0", "x1", "y1")))
    pairs = rows(labels, "").join(rows(right, "v_"), [*PAGE, "_band"]).where(F.col("_band") == F.floor(F.greatest("y0", "v_y0") / band))
    pairs = pairs.where((F.col("v_x0") >= F.col("x1")) & (interval_overlap(F.col("y0"), F.col("y1"), F.col("v_y0"), F.col("v_y1")) >= least))
    found = pairs.groupBy("doc_id", "observation_id").agg(F.count("*").alias("n"), F.min("v_observation_id").alias("v"))
    return found.select("doc_id", F.col("observation_id").alias("label_id"), "n", F.when(F.col("n") == 1, F.col("v")).alias("value_id"))


def suppressed(boxes: DataFrame, least: float = 0.8) -> DataFrame:
    """Boxes that stay after greedy suppression by IoU in reading order; exact repeats go first.

    The first independent set in reading order, by rounds of joins: a box is kept once all earlier boxes that it overlaps are out, and out once one of them is kept.
    Pairs come from the page's grid once; a round reads only what is still open, so the rounds are half the longest chain of boxes of which each hangs on the one before.
    """
    first = F.row_number().over(Window.partitionBy(*PAGE, "x0", "y0", "x1", "y1").orderBy("observation_id"))
    distinct = boxes.select(*PAGE, "observation_id", "x0", "y0", "x1", "y1").withColumn("_k", first).where("_k = 1").drop("_k")
    earlier = F.struct("r_y0", "r_x0", "r_observation_id") < F.struct("y0", "x0", "observation_id")
    pairs = page_pairs(distinct, distinct, earlier & (iou(Box.of(), Box.of("r_")) >= least))
    edges = written(pairs.select(*PAGE, "observation_id", F.col("r_observation_id").alias("before_id")), "suppression")
    out = None
    node, open_edges = [*PAGE, "observation_id"], edges
    while not open_edges.isEmpty():
        waiting = open_edges.select(*node).distinct()
        free = open_edges.select(*PAGE, F.col("before_id").alias("observation_id")).distinct().join(waiting, node, "left_anti")  # kept: nothing that is open comes before it
        kept = free.select(*PAGE, F.col("observation_id").alias("before_id"))
        gone = written(open_edges.join(kept, [*PAGE, "before_id"], "left_semi").select(*node).distinct(), "suppressed")
        out = gone if out is None else out.unionByName(gone)
        # What is out bears on nothing, and what is kept has done its part: a box left without an edge is kept.
        rest = open_edges.join(gone, node, "left_anti").join(gone.withColumnRenamed("observation_id", "before_id"), [*PAGE, "before_id"], "left_anti")
        open_edges = written(rest, "suppression")
    stays = distinct.select(*node)
    return stays if out is None else stays.join(out, node, "left_anti")


# Fixed values, in points: radius, rings and directions of placement, and weights of texts and leaders that a leader crosses and of near neighbours.
RADIUS, RINGS = 12.0, (18.0, 30.0, 42.0, 56.0, 72.0, 90.0)
DIRECTIONS = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
PER_TEXT, PER_LEADER, PER_NEIGHBOUR, NEIGHBOUR = 20.0, 12.0, 4.0, 5 * RADIUS
_WAYS = np.array([(dx * r, dy * r) for r in RINGS for dx, dy in DIRECTIONS])


REACH = float(np.abs(_WAYS).max()) + RADIUS  # of an item's places, with their circles
_CELL = 2 * (REACH - RADIUS)  # two leaders can only cross if their markers are in neighbouring cells of this size


_SLACK = 1e-6  # of tests that come before exact ones


def _near(x: np.ndarray, y: np.ndarray, box: tuple, radius: float) -> np.ndarray:
    """Which circles around (x, y) meet which boxes (x0, y0, x1, y1), pair by pair; distances are worked out in the square around the circle only."""
    dx, dy = x - np.minimum(np.maximum(x, box[0]), box[2]), y - np.minimum(np.maximum(y, box[1]), box[3])
    hit = (np.abs(dx) < radius + _SLACK) & (np.abs(dy) < radius + _SLACK)
    hit[hit] = np.hypot(dx[hit], dy[hit]) < radius
    return hit


def _meet(a: tuple, b: tuple) -> np.ndarray:
    """Which boxes meet which, strictly, pair by pair."""
    return (a[0] < b[2]) & (a[1] < b[3]) & (b[0] < a[2]) & (b[1] < a[3])


def _crossed_boxes(c: tuple, t: tuple, b: tuple) -> np.ndarray:
    """Which leaders from c to t reach which boxes, pair by pair: an end inside, or an edge on the way."""
    inside = lambda p: (p[0] >= b[0]) & (p[1] >= b[1]) & (p[0] <= b[2]) & (p[1] <= b[3])
    hit = inside(c) | inside(t)
    for axis in (0, 1):
        step, along = t[axis] - c[axis], t[1 - axis] - c[1 - axis]
        with np.errstate(divide="ignore", invalid="ignore"):
            for edge in (b[axis], b[axis + 2]):
                ratio = (edge - c[axis]) / step
                other = c[1 - axis] + ratio * along
                hit |= (step != 0) & (ratio >= 0) & (ratio <= 1) & (other >= b[1 - axis]) & (other <= b[3 - axis])
    return hit


def _crossed_leaders(p: tuple, q: tuple, r: tuple, s: tuple) -> np.ndarray:
    """Which leaders from p to q properly cross which placed ones from r to s, pair by pair."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    same = lambda u, v: (u[0] == v[0]) & (u[1] == v[1])
    shared = same(p, r) | same(p, s) | same(q, r) | same(q, s)
    return ~shared & (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)


class _Grid:
    """Numbers of boxes or points by cell of the page; it grows while markers are placed."""

    def __init__(self, cell: float) -> None:
        self.cell, self.held = cell, defaultdict(list)

    def add(self, k: int, x0: float, y0: float, x1: float, y1: float) -> None:
        for gx in range(int(x0 // self.cell), int(x1 // self.cell) + 1):
            for gy in range(int(y0 // self.cell), int(y1 // self.cell) + 1):
                self.held[gx, gy].append(k)

    def near(self, x0: float, y0: float, x1: float, y1: float) -> list[int]:
        """Numbers that may lie in the rectangle, in order."""
        cells = [(gx, gy) for gx in range(int(x0 // self.cell), int(x1 // self.cell) + 1) for gy in range(int(y0 // self.cell), int(y1 // self.cell) + 1)]
        found = [self.held[c] for c in cells if c in self.held]
        return sorted(set().union(*found)) if len(found) > 1 else found[0] if found else []


def _runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of numbers as pairs (number of the run, number), run by run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, starts[run] + np.arange(len(run)) - (np.cumsum(counts) - counts)[run]


def _around(points: np.ndarray, pages: np.ndarray, reach: float | np.ndarray, boxes: np.ndarray, box_pages: np.ndarray):
    """Pairs (number of a point, number of a box) of a page's boxes within reach of its points, by point, for some points at once: first and last point, pairs."""
    if not len(boxes):
        return
    reach, edges = np.broadcast_to(reach, len(points)), np.unique(boxes[:, 0])
    order = np.lexsort((boxes[:, 0], box_pages))
    size = len(edges) + 1
    begun = box_pages[order] * size + np.searchsorted(edges, boxes[order, 0])
    widest = float((boxes[:, 2] - boxes[:, 0]).max())
    first = np.searchsorted(begun, pages * size + np.searchsorted(edges, points[:, 0] - reach - max(widest, 0.0) - _SLACK))
    last = np.searchsorted(begun, pages * size + np.searchsorted(edges, points[:, 0] + reach, "right"))
    total, start = np.cumsum(last - first), 0
    while start < len(points):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PAIRS, "right")))
        left, right = _runs(first[start:stop], (last - first)[start:stop])
        left, right = left + start, order[right]
        b, p, r = boxes[right], points[left], reach[left]
        close = (b[:, 0] <= p[:, 0] + r) & (b[:, 1] <= p[:, 1] + r) & (b[:, 2] >= p[:, 0] - r) & (b[:, 3] >= p[:, 1] - r)
        yield start, stop, left[close], right[close]
        start = stop


def _by_point(left: np.ndarray, values: np.ndarray, first: int, last: int) -> np.ndarray:
    """How many pairs of each point hold; the pairs come point by point."""
    out = np.zeros((last - first, values.shape[1]), np.int64)
    if len(left):
        starts = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
        out[left[starts] - first] = np.add.reduceat(values, starts, axis=0, dtype=np.int64)
    return out


def _columns(page: pa.Table, names: list[str], dtype: type = float) -> np.ndarray:
    return np.column_stack([page.column(c).to_numpy() for c in names]).astype(dtype)


_BOX = ["x0", "y0", "x1", "y1"]
_PAIRS = 1 << 15  # pairs of items and boxes compared in one step
_LONG = 4096  # markers of a page before its later ones look for neighbours in a grid


def _fixed_flags(t: np.ndarray, h: np.ndarray, page: np.ndarray, boxes: np.ndarray, guarded: np.ndarray, guarded_page: np.ndarray, size: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """What does not depend on other markers, for every place: flags (1 outside, 2 protected, 4 text), and leader lengths with the texts under them."""
    n, ways = len(t), _WAYS.T[:, None, :]
    flags, ahead = np.zeros((n, len(_WAYS)), np.uint8), np.zeros((n, len(_WAYS)))
    for start in range(0, n, _PAIRS // 8):
        at = slice(start, start + _PAIRS // 8)
        x, y = t[at, :1] + ways[0], t[at, 1:] + ways[1]
        flags[at] = (x < RADIUS) | (y < RADIUS) | (x > size[0] - RADIUS) | (y > size[1] - RADIUS)
        ahead[at] = np.hypot(x - t[at, :1], y - t[at, 1:])
    for bit, others, pages in ((2, guarded, guarded_page), (4, boxes, page)):
        for first, last, left, right in _around(t, page, REACH, others, pages):
            x, y = t[left, :1] + ways[0], t[left, 1:] + ways[1]
            b, w = tuple(others[right].T[:, :, None]), h[left]
            own = (x - w[:, :1], y - w[:, 1:], x + w[:, :1], y + w[:, 1:])
            flags[first:last] |= np.where(_by_point(left, _near(x, y, b, RADIUS) | _meet(own, b), first, last) > 0, bit, 0).astype(np.uint8)
            if bit == 4:
                tx, ty = t[left, :1], t[left, 1:]
                foreign = (boxes[right] != boxes[left]).any(axis=1)[:, None]
                hit = foreign & (np.minimum(x, tx) <= b[2] + _SLACK) & (np.maximum(x, tx) >= b[0] - _SLACK) & (np.minimum(y, ty) <= b[3] + _SLACK) & (np.maximum(y, ty) >= b[1] - _SLACK)
                pair, way = np.nonzero(hit)
                hit[pair, way] = _crossed_boxes((x[pair, way], y[pair, way]), (tx[pair, 0], ty[pair, 0]), tuple(others[right[pair]].T))
                ahead[first:last] += _by_point(left, hit, first, last) * PER_TEXT
    return flags, ahead


def _turns(turn: np.ndarray):
    """The k-th items of all pages, some at once, and k."""
    by_turn = np.argsort(turn, kind="stable")
    start = 0
    for k, n in enumerate(np.bincount(turn) if len(turn) else ()):
        some = max(1, _PAIRS // max(k, 16))
        for first in range(start, start + n, some):
            yield by_turn[first : min(first + some, start + n)], k
        start += n


def _before(items: np.ndarray, k: int, start_of: np.ndarray, page: np.ndarray, grids: dict, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in items, marker) of the k-th items of some pages and the markers before them: all of the page, or on a long page those in the cells between low and high."""
    if k < _LONG:
        return _runs(start_of[items], np.full(len(items), k))
    found = [grids[int(page[i])].near(*low[i], *high[i]) for i in items]
    return np.repeat(np.arange(len(items)), [len(f) for f in found]), np.array([j for f in found for j in f], np.int64)


def _remember(items: np.ndarray, page: np.ndarray, grids: dict, at: np.ndarray) -> None:
    """Long pages keep their markers in grids."""
    for i in items[np.isin(page[items], list(grids))] if grids else ():
        grids[int(page[i])].add(int(i), *at[i], *at[i])


def _place(width: float, height: float):
    """The markers of some pages, in the order of their numbers.

    What does not depend on other markers (page, texts, protected boxes, texts under leaders) is worked out for many items at once, each with the boxes within its reach; then
    the first markers of all pages are placed in one step, then the second ones, each compared with the markers placed before it on its page.
    """

    def run(table: pa.Table) -> pa.Table:
        all_pages = np.cumsum(_starts(table, list(PAGE))) - 1
        is_item = table.column("number").is_valid().to_numpy()
        guarded, rows, page = _columns(table, _BOX)[~is_item], table.filter(pa.array(is_item)), all_pages[is_item]
        boxes, n = _columns(rows, _BOX), rows.num_rows
        wide = np.maximum(5.0, np.char.str_len(rows.column("number").to_numpy().astype(str)) * DIGIT * FONT) / 2
        half = np.column_stack([wide, np.full(n, LINE * FONT / 2)])
        targets = (boxes[:, :2] + boxes[:, 2:]) / 2
        bits, ahead = _fixed_flags(targets, half, page, boxes, guarded, all_pages[~is_item], (width, height))
        unreadable = np.hypot(*half.T) > RADIUS - INSET
        fixed = np.bitwise_count(bits) + 2 * unreadable[:, None].astype(np.uint8)
        start_of = np.searchsorted(page, page)
        turn = np.arange(n) - start_of
        at, glyphs, moved_flags, chosen = np.zeros((n, 2)), np.zeros((n, 4)), np.zeros((3, n), bool), np.zeros(n, np.int64)
        long_pages = {int(p): _Grid(_CELL) for p in np.unique(page[turn >= _LONG])}
        cells_low, cells_high = targets - _CELL, targets + _CELL

        def step(items: np.ndarray, k: int) -> None:
            """The k-th markers of some pages."""
            who, other = _before(items, k, start_of, page, long_pages, cells_low, cells_high)
            reach, t, far, aims = REACH - RADIUS, targets[items[who]], at[other], targets[other]
            low, high = np.minimum(far, aims), np.maximum(far, aims)
            # Leaders that one of this item could cross, and markers that one of its places could be near.
            beside = (low[:, 0] <= t[:, 0] + reach) & (high[:, 0] >= t[:, 0] - reach) & (low[:, 1] <= t[:, 1] + reach) & (high[:, 1] >= t[:, 1] - reach)
            within = (np.abs(far[:, 0] - t[:, 0]) <= reach + NEIGHBOUR) & (np.abs(far[:, 1] - t[:, 1]) <= reach + NEIGHBOUR)
            m = len(items)
            by_item = lambda mask: (other[mask], np.cumsum(c := np.bincount(who[mask], minlength=m)) - c, c)
            (near, near_at, near_n), (lines, line_at, line_n) = by_item(within), by_item(beside)

            def against(i: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Three flags of these places of items against the markers around, and how many of those are near neighbours."""
                one, j = _runs(near_at[i], near_n[i])
                k, j = items[i[one]], near[j]
                x, y = targets[k, 0] + _WAYS[way[one], 0], targets[k, 1] + _WAYS[way[one], 1]
                apart = np.hypot(x - at[j, 0], y - at[j, 1])
                g, h = (x - half[k, 0], y - half[k, 1], x + half[k, 0], y + half[k, 1]), tuple(glyphs[j].T)
                count = lambda hit: np.bincount(one[hit], minlength=len(i))
                mixed = _near(at[j, 0], at[j, 1], g, RADIUS) | _near(x, y, h, RADIUS)
                return np.stack([count(apart < 2 * RADIUS), count(_meet(g, h)), count(mixed)]) > 0, count(apart < NEIGHBOUR)

            # Places with the fewest fixed flags first: if one of them has no other flag, no other place can be better.
            f = fixed[items]
            i, way = np.nonzero(f == f.min(axis=1)[:, None])
            moved, close = against(i, way)
            again = np.bincount(i[~moved.any(axis=0)], minlength=m) == 0
            if again.any():
                stays = ~again[i]
                i2, way2 = np.repeat(np.flatnonzero(again), len(_WAYS)), np.tile(np.arange(len(_WAYS)), int(again.sum()))
                moved2, close2 = against(i2, way2)
                i, way, moved, close = np.append(i[stays], i2), np.append(way[stays], way2), np.concatenate([moved[:, stays], moved2], axis=1), np.append(close[stays], close2)
            total = f[i, way] + moved.sum(axis=0)
            fewest = np.full(m, 127)
            np.minimum.at(fewest, i, total)
            tied = total == fewest[i]
            i, way, moved, close = i[tied], way[tied], moved[:, tied], close[tied]
            one, j = _runs(line_at[i], line_n[i])
            k, j = items[i[one]], lines[j]
            p = (targets[k, 0] + _WAYS[way[one], 0], targets[k, 1] + _WAYS[way[one], 1])
            crossed = np.bincount(one[_crossed_leaders(p, tuple(targets[k].T), tuple(at[j].T), tuple(targets[j].T))], minlength=len(i))
            score = ahead[items[i], way] + crossed * PER_LEADER + close * PER_NEIGHBOUR
            # Places come ring by ring and direction by direction, so the first of equals is the right one.
            order = np.lexsort((way, score, i))
            best = order[np.append(True, i[order][1:] != i[order][:-1])]
            chosen[items], moved_flags[:, items] = way[best], moved[:, best]
            c = targets[items] + _WAYS[way[best]]
            at[items], glyphs[items] = c, np.concatenate([c - half[items], c + half[items]], axis=1)
            _remember(items, page, long_pages, at)

        for items, k in _turns(turn):
            step(items, k)
        own = bits[np.arange(n), chosen]
        hard = np.column_stack([own & 1, unreadable, unreadable, own & 2, own & 4, *moved_flags]).astype(bool) if n else np.zeros((0, 8), bool)
        said: dict[bytes, str] = {}
        flags = []
        for bad in hard:
            key = bad.tobytes()
            if key not in said:
                said[key] = ",".join(name for name, b in zip(FLAGS, bad, strict=True) if b)
            flags.append(said[key])
        out = rows.select([*PAGE, "observation_id"])
        status = ["manual_required" if f else "placed" for f in flags]
        for name, values in (("cx", at[:, 0]), ("cy", at[:, 1]), ("flags", pa.array(flags, pa.string())), ("status", pa.array(status, pa.string()))):
            out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
        return out

    return run


# Fixed values, in points: radius, gap and inset of a candidate's marker, least leader; hard flags of a placement, in order.
MARK, MARK_GAP, MARK_INSET, LEAST_LEADER = 10.0, 2.0, 1.0, 15.0
FLAGS = ("outside_cropbox", "owner_glyph_outside_circle", "unreadable_number", "protected_overlap", "source_text_overlap", "circle_overlap", "glyph_overlap", "glyph_circle_overlap")


def _mark(width: float, height: float):
    """Candidate markers of some pages in list order: sixteen places around a box, cut to the page; overlaps, short leaders and distance decide.  The k-th markers of all pages are placed in one step."""
    edge, apart = MARK + MARK_INSET, 2 * MARK + MARK_GAP

    def run(rows: pa.Table) -> pa.Table:
        page = np.cumsum(_starts(rows, list(PAGE))) - 1
        boxes, n = _columns(rows, _BOX), rows.num_rows
        x0, y0, x1, y1 = boxes.T
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        ways = []
        for ring in (0, 1):
            o = MARK + MARK_GAP + ring * (MARK * 2 + MARK_GAP * 2)
            ways += [(x1 + o, y0 - o), (x1 + o, y1 + o), (x0 - o, y0 - o), (x0 - o, y1 + o), (x1 + o, my), (x0 - o, my), (mx, y0 - o), (mx, y1 + o)]
        cut = lambda v, size: np.minimum(np.maximum(v, edge), max(edge, size - edge))
        x, y = np.stack([cut(x, width) for x, _ in ways], axis=1), np.stack([cut(y, height) for _, y in ways], axis=1)
        again = np.stack([((x[:, :k] == x[:, k : k + 1]) & (y[:, :k] == y[:, k : k + 1])).any(axis=1) for k in range(len(ways))], axis=1)  # a place that came before
        rank = np.cumsum(~again, axis=1) - 1
        bx0, by0, bx1, by1 = boxes.T[:, :, None]
        near_x, near_y = np.clip(x, bx0, bx1), np.clip(y, by0, by1)
        leader = np.hypot(x - near_x, y - near_y)
        deep = np.minimum(np.minimum(x - bx0, bx1 - x), np.minimum(y - by0, by1 - y))
        leader = np.where((near_x == x) & (near_y == y), deep, leader)
        hits = np.zeros((n, len(ways)))
        reach = np.maximum(np.abs(x - mx[:, None]), np.abs(y - my[:, None])).max(axis=1, initial=0.0) + MARK + MARK_GAP
        for first, last, left, right in _around(np.column_stack([mx, my]), page, reach, boxes, page):
            hits[first:last] = _by_point(left, _near(x[left], y[left], tuple(boxes[right].T[:, :, None]), MARK + MARK_GAP), first, last)
        ahead = [hits * 500, np.maximum(0.0, LEAST_LEADER - leader) * 1e4, np.hypot(x - x[:, :1], y - y[:, :1]) * 10, rank]
        at = np.zeros((n, 2))
        low, high = np.column_stack([x.min(axis=1), y.min(axis=1)]) - apart, np.column_stack([x.max(axis=1), y.max(axis=1)]) + apart
        start_of = np.searchsorted(page, page)
        turn = np.arange(n) - start_of
        long_pages = {int(p): _Grid(apart) for p in np.unique(page[turn >= _LONG])}
        for items, k in _turns(turn):
            who, other = _before(items, k, start_of, page, long_pages, low, high)
            k_of, far = items[who], at[other]
            close = ((far >= low[k_of]) & (far <= high[k_of])).all(axis=1)
            who, k_of, far = who[close], k_of[close], far[close]
            met = np.hypot(x[k_of] - far[:, :1], y[k_of] - far[:, 1:]) < apart
            score = _by_point(who, met, 0, len(items)) * 1e6
            for part in ahead:
                score = score + part[items]
            best = np.argmin(np.where(again[items], np.inf, score), axis=1)
            at[items] = np.column_stack([x[items, best], y[items, best]])
            _remember(items, page, long_pages, at)
        return rows.select([*PAGE, "observation_id"]).append_column("cx", pa.array(at[:, 0])).append_column("cy", pa.array(at[:, 1]))

    return run


def candidate_markers(items: DataFrame, width: float, height: float) -> DataFrame:
    """A marker for each candidate of a page, placed in list order."""
    return items.select(*PAGE, "observation_id", "number", "x0", "y0", "x1", "y1").transform(by_tables, list(PAGE), ["number", "observation_id"], _mark(width, height), "doc_id bigint, page_index int, observation_id string, cx double, cy double")


def placed_markers(items: DataFrame, width: float, height: float, protected: DataFrame | None = None) -> DataFrame:
    """Each page's markers in the order of their numbers: fewest hard flags, then the best score, ring and direction.  None is dropped.

    protected: page, x0 .. y1 of boxes that a marker should keep off.
    """
    schema = "doc_id bigint, page_index int, observation_id string, cx double, cy double, flags string, status string"
    rows = items.select(*PAGE, "observation_id", "number", "x0", "y0", "x1", "y1")
    if protected is not None:
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("observation_id", "number")]
        with_items = protected.join(rows.select(*PAGE).distinct(), [*PAGE], "left_semi")
        rows = rows.unionByName(with_items.select(*PAGE, *none, "x0", "y0", "x1", "y1"))
    return by_tables(rows, list(PAGE), ["number", "observation_id"], _place(width, height), schema)


def marker_overlaps(placed: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Pairs of a page's markers whose circles overlap, whatever order they were placed in."""
    boxes = placed.select(*PAGE, "observation_id", "cx", "cy", (F.col("cx") - radius).alias("x0"), (F.col("cy") - radius).alias("y0"), (F.col("cx") + radius).alias("x1"), (F.col("cy") + radius).alias("y1")).withColumnsRenamed({"cx": "mx", "cy": "my"})
    close = F.hypot(F.col("mx") - F.col("r_mx"), F.col("my") - F.col("r_my")) < 2 * radius
    return page_pairs(boxes, boxes, (F.col("observation_id") < F.col("r_observation_id")) & close).select(*PAGE, F.col("observation_id").alias("left_id"), F.col("r_observation_id").alias("right_id"))
