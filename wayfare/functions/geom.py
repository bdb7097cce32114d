"""Geometry of rings and segments as column expressions.

A ring is an ``ARRAY<STRUCT<x, y>>`` without its first point repeated.  With integer coordinates every test here
is exact.  All functions return null for a null ring.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def turned(ring: Column | str) -> Column:
    """The ring from its second point on: the next point of each."""
    ring = col(ring)
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column | str) -> Column:
    """Array of (x1, y1, x2, y2), one for each point and the next one around."""
    ring = col(ring)
    return F.zip_with(ring, turned(ring), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _total(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda acc, v: acc + v)


def twice_area(ring: Column | str, kind: str = "long") -> Column:
    """Twice the signed area; positive for rings that run clockwise where y points down."""
    cross = F.transform(edges(ring), lambda e: (e["x1"] * e["y2"] - e["x2"] * e["y1"]).cast(kind))
    return _total(cross, F.lit(0).cast(kind))


def oriented(ring: Column | str) -> Column:
    """The ring with positive area: reversed if it is negative."""
    return F.when(twice_area(ring, "double") < 0, F.reverse(col(ring))).otherwise(col(ring))


def closed(ring: Column | str) -> Column:
    """The ring with its first point repeated at the end, unless it is there."""
    ring = col(ring)
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def cents(v: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(v * 100 + 0.5) / 100


def _moment(ring: Column | str, axis: str) -> Column:
    each = F.transform(edges(ring), lambda e: ((e[f"{axis}1"] + e[f"{axis}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])).cast("double"))
    return _total(each, F.lit(0.0)) / (3 * twice_area(ring, "double"))


def centroid(ring: Column | str) -> Column:
    """struct(cx, cy) by area; null without area."""
    some = twice_area(ring, "double") != 0
    return F.when(some, F.struct(_moment(ring, "x").alias("cx"), _moment(ring, "y").alias("cy")))


def moment_center(ring: Column | str) -> Column:
    """The centroid cut to whole numbers; the first point of a ring without area."""
    ring = col(ring)
    whole = lambda axis: F.when(twice_area(ring, "double") != 0, _moment(ring, axis)).otherwise(F.element_at(ring, 1)[axis]).cast("long")
    return F.struct(whole("x").alias("cx"), whole("y").alias("cy"))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Sign of the turn a, b, c: 1, 0 or -1."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def on_segment(px: Column, py: Column, e: Column) -> Column:
    """True for points of a closed segment."""
    between = px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return between & (turn(e["x1"], e["y1"], e["x2"], e["y2"], px, py) == 0)


def segments_meet(a: Column, b: Column) -> Column:
    """True if two closed segments have a point in common."""
    o1, o2 = turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]), turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    o3, o4 = turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]), turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    ends = on_segment(b["x1"], b["y1"], a) | on_segment(b["x2"], b["y2"], a) | on_segment(a["x1"], a["y1"], b) | on_segment(a["x2"], a["y2"], b)
    return ((o1 * o2 < 0) & (o3 * o4 < 0)) | ends


def on_boundary(ring: Column | str, px: Column, py: Column) -> Column:
    return F.exists(edges(ring), lambda e: on_segment(px, py, e))


def _crossings(ring: Column | str, px: Column, py: Column) -> Column:
    """Edges that a ray to the right of the point crosses, each with its lower end but not its upper one."""

    def crosses(e: Column) -> Column:
        side = (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])
        return ((e["y1"] > py) != (e["y2"] > py)) & F.when(e["y2"] > e["y1"], side > 0).otherwise(side < 0)

    return F.size(F.filter(edges(ring), crosses))


def contains(ring: Column | str, px: Column | str, py: Column | str) -> Column:
    """True for points strictly inside (even-odd)."""
    px, py = col(px), col(py)
    return (_crossings(ring, px, py) % 2 == 1) & ~on_boundary(ring, px, py)


def covers(ring: Column | str, px: Column | str, py: Column | str) -> Column:
    """True for points inside or on the boundary."""
    px, py = col(px), col(py)
    return (_crossings(ring, px, py) % 2 == 1) | on_boundary(ring, px, py)


def meets(ring: Column | str, seg: Column) -> Column:
    """True if a segment (x1, y1, x2, y2) touches, crosses or lies in a polygon."""
    return F.exists(edges(ring), lambda e: segments_meet(e, seg)) | covers(ring, seg["x1"], seg["y1"])


def is_valid(ring: Column | str) -> Column:
    """True for rings with area and no two edges that meet, but neighbours in their common point alone."""
    ring = col(ring)
    n, e = F.size(ring), edges(ring)
    numbered = F.transform(e, lambda s, k: F.struct(k.alias("k"), s.alias("s")))

    def bad(a: Column, b: Column) -> Column:
        gap = b["k"] - a["k"]
        apart = (gap > 1) & (gap < n - 1)
        # neighbours may not fold back onto each other
        folded = lambda p, q: on_segment(q["x2"], q["y2"], p) | on_segment(p["x1"], p["y1"], q)
        near = F.when(gap == 1, folded(a["s"], b["s"])).when((gap == n - 1) & (n > 2), folded(b["s"], a["s"])).otherwise(F.lit(False))
        return F.when(apart, segments_meet(a["s"], b["s"])).otherwise(near)

    crossing = F.exists(numbered, lambda a: F.exists(numbered, lambda b: (b["k"] > a["k"]) & bad(a, b)))
    return (n >= 3) & (twice_area(ring, "double") != 0) & ~crossing


def segment_distance2(px: Column, py: Column, e: Column) -> Column:
    """Squared distance of a point and a segment."""
    dx, dy = (e["x2"] - e["x1"]).cast("double"), (e["y2"] - e["y1"]).cast("double")
    size = dx * dx + dy * dy
    along = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / F.when(size == 0, F.lit(1.0)).otherwise(size))))
    fx, fy = e["x1"] + along * dx - px, e["y1"] + along * dy - py
    return fx * fx + fy * fy


def path_length(points: Column | str) -> Column:
    """Length of an open line; 0 for fewer than two points."""
    points = col(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return _total(steps, F.lit(0.0))


def angle_between(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two vectors; 0 if one is shorter than 1e-6."""
    nu, nv = F.hypot(ux, uy), F.hypot(vx, vy)
    cosine = (ux * vx + uy * vy) / (nu * nv)
    return F.when((nu < 1e-6) | (nv < 1e-6), F.lit(0.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def strip(c: Column | str) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(col(c), r"^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$", "")


def key_part(c: Column | str) -> Column:
    """A unit's key part as it is compared: text without white space around it, null as ''."""
    return F.coalesce(strip(col(c).cast("string")), F.lit(""))
