"""Geometry of boxes, circles, segments and page matrices as column expressions.

A box is four columns (x0, y0, x1, y1) in points with y downwards.  Every function returns columns, so all of it stays in generated code.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS_TO_MM = 25.4 / 72


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


class Point(NamedTuple):
    x: Column
    y: Column


def affine(m: tuple, p: Point) -> Point:
    """(a, b, c, d, e, f) applied to a point."""
    a, b, c, d, e, f = m
    return Point(a * p.x + c * p.y + e, b * p.x + d * p.y + f)


def page_matrix(rotation: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Matrix from page to rendered page for the rotations 0, 90, 180 and 270; width and height are those of the page."""
    zero, one = F.lit(0.0), F.lit(1.0)
    by_rotation = {0: (one, zero, zero, one, zero, zero), 90: (zero, one, -one, zero, height, zero), 180: (-one, zero, zero, -one, width, height), 270: (zero, -one, one, zero, zero, width)}
    out = []
    for k in range(6):
        chosen = F.when(rotation == 0, by_rotation[0][k])
        for r in (90, 180, 270):
            chosen = chosen.when(rotation == r, by_rotation[r][k])
        out.append(chosen)
    return tuple(out)


def from_rendered(rotation: Column, width: Column, height: Column, p: Point) -> Point:
    """The place on the page of a point of the rendered page: ``page_matrix`` the other way."""
    x = F.when(rotation == 0, p.x).when(rotation == 90, p.y).when(rotation == 180, width - p.x).when(rotation == 270, width - p.y)
    y = F.when(rotation == 0, p.y).when(rotation == 90, height - p.x).when(rotation == 180, height - p.y).when(rotation == 270, p.x)
    return Point(x, y)


def valid(b: Box) -> Column:
    """All four finite, and a positive area."""
    finite = [~F.isnan(v) & v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) for v in b]
    return finite[0] & finite[1] & finite[2] & finite[3] & (b.x1 > b.x0) & (b.y1 > b.y0)


def clip(b: Box, to: Box) -> Box:
    """The part of a box inside another; null where nothing is left or the box is inverted."""
    x0, y0, x1, y1 = F.greatest(b.x0, to.x0), F.greatest(b.y0, to.y0), F.least(b.x1, to.x1), F.least(b.y1, to.y1)
    good = (b.x1 >= b.x0) & (b.y1 >= b.y0) & (x1 > x0) & (y1 > y0)
    return Box(*(F.when(good, v) for v in (x0, y0, x1, y1)))


def normalised(b: Box, width: Column, height: Column) -> Box:
    return Box(b.x0 / width, b.y0 / height, b.x1 / width, b.y1 / height)


def centre(b: Box) -> Point:
    return Point((b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2)


def area(b: Box) -> Column:
    return (b.x1 - b.x0) * (b.y1 - b.y0)


def expanded(b: Box, by: Column | float) -> Box:
    return Box(b.x0 - by, b.y0 - by, b.x1 + by, b.y1 + by)


def millimetres(points: Column) -> Column:
    return points * F.lit(POINTS_TO_MM)


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share."""
    return F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def intersect(a: Box, b: Box) -> Column:
    """Strictly: boxes that touch do not intersect."""
    return (a.x1 > b.x0) & (b.x1 > a.x0) & (a.y1 > b.y0) & (b.y1 > a.y0)


def iou(a: Box, b: Box) -> Column:
    shared = overlap(a, b)
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def overlap_fraction(a: Box, b: Box) -> Column:
    """Shared area over the smaller area."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, overlap(a, b) / smaller).otherwise(F.lit(0.0))


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter interval."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / shorter).otherwise(F.lit(0.0))


def axis_gaps(a: Box, b: Box) -> Point:
    zero = F.lit(0.0)
    return Point(F.greatest(zero, b.x0 - a.x1, a.x0 - b.x1), F.greatest(zero, b.y0 - a.y1, a.y0 - b.y1))


def circle_meets_box(c: Point, radius: Column | float, b: Box) -> Column:
    """The nearest point of the box is strictly inside the circle."""
    dx, dy = c.x - F.least(F.greatest(c.x, b.x0), b.x1), c.y - F.least(F.greatest(c.y, b.y0), b.y1)
    return F.hypot(dx, dy) < radius


def corners_inside_circle(b: Box, c: Point, radius: Column | float) -> Column:
    far = [F.hypot(x - c.x, y - c.y) <= radius for x in (b.x0, b.x1) for y in (b.y0, b.y1)]
    return far[0] & far[1] & far[2] & far[3]


def _inside(v: Column, low: Column, high: Column) -> Column:
    return (v >= low) & (v <= high)


def segment_meets_box(p: Point, q: Point, b: Box) -> Column:
    """An end lies in the box, or the segment reaches one of its edges."""
    dx, dy = q.x - p.x, q.y - p.y
    ends = (_inside(p.x, b.x0, b.x1) & _inside(p.y, b.y0, b.y1)) | (_inside(q.x, b.x0, b.x1) & _inside(q.y, b.y0, b.y1))
    hits = []
    for edge in (b.x0, b.x1):
        t = (edge - p.x) / F.nullif(dx, F.lit(0.0))
        hits.append(F.coalesce(_inside(t, F.lit(0.0), F.lit(1.0)) & _inside(p.y + t * dy, b.y0, b.y1), F.lit(False)))
    for edge in (b.y0, b.y1):
        t = (edge - p.y) / F.nullif(dy, F.lit(0.0))
        hits.append(F.coalesce(_inside(t, F.lit(0.0), F.lit(1.0)) & _inside(p.x + t * dx, b.x0, b.x1), F.lit(False)))
    return ends | hits[0] | hits[1] | hits[2] | hits[3]


def segments_cross(p: Point, q: Point, r: Point, s: Point) -> Column:
    """A proper crossing; a shared end is none."""

    def side(a: Point, b: Point, c: Point) -> Column:
        return F.signum((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))

    same = lambda a, b: (a.x == b.x) & (a.y == b.y)
    shared = same(p, r) | same(p, s) | same(q, r) | same(q, s)
    return ~shared & (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)


def angles_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Equal modulo 360 degrees, the tolerance included."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180) <= tolerance


def degrees_of(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def position_bucket(b: Box, grid: float = 0.05) -> Point:
    """Grid cell of the centre of a normalised box, rounded half to even."""
    c = centre(b)
    return Point(F.bround(c.x / grid).cast("int"), F.bround(c.y / grid).cast("int"))


def in_padded_frame(text: Box, padded: Box) -> Column:
    """The centre of a text of some area is in a padded frame, or half of that area is."""
    c = centre(text)
    return (area(text) > 0) & ((_inside(c.x, padded.x0, padded.x1) & _inside(c.y, padded.y0, padded.y1)) | (overlap(text, padded) >= 0.5 * area(text)))


def belongs_to_frame(text: Box, frame: Box, padding: float) -> Column:
    """The centre is in the padded frame, or half of the text's area is."""
    return in_padded_frame(text, expanded(frame, padding))


def crop(b: Box, width: Column, height: Column) -> Box:
    """A tenth of each side as padding, 6 to 24 points, cut at the page."""
    px, py = (F.least(F.greatest((hi - lo) / 10, F.lit(6.0)), F.lit(24.0)) for lo, hi in ((b.x0, b.x1), (b.y0, b.y1)))
    return Box(F.greatest(F.lit(0.0), b.x0 - px), F.greatest(F.lit(0.0), b.y0 - py), F.least(width, b.x1 + px), F.least(height, b.y1 + py))
