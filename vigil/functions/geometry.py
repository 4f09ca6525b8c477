"""Geometry of boxes, points, lines and polygons as Column expressions.

Polygons are arrays of struct<x, y>, closed by their first point; edges lie
inside. Frames are width x height in pixels unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feet at or below FEET_AT of the frame's height are cut off by it and put at FEET_TO; edges are EDGE of a side wide.
FEET_AT, FEET_TO, EDGE = 0.98, 0.90, 0.02


def foot(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def clamp_feet(y: Column, height: float) -> Column:
    return F.when(y >= FEET_AT * height, F.lit(FEET_TO * height)).otherwise(y)


def touches_edge(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    return (x1 <= EDGE * width) | (y1 <= EDGE * height) | (x2 >= width - EDGE * width) | (y2 >= height - EDGE * height)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes (x1, y1, x2, y2) of two aliases; 0 where they don't overlap."""
    side = lambda lo, hi: F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}"))
    w, h = side("x1", "x2"), side("y1", "y2")
    of = lambda t: area(*[F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2")])
    union = of(a) + of(b) - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(w * h / union)


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def edges(points: Column) -> Column:
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, after, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def covers(sides: Column, px: Column, py: Column) -> Column:
    """Whether a point lies in the polygon of these edges or on one of them."""
    on = F.exists(
        sides,
        lambda e: (cross(e["ax"], e["ay"], e["bx"], e["by"], px, py) == 0)
        & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    hit = lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    odd = F.aggregate(sides, F.lit(0), lambda n, e: n + F.when(hit(e), 1).otherwise(0)) % 2 == 1
    return on | odd


def side_of_line(ax: float, ay: float, bx: float, by: float, px: Column, py: Column) -> Column:
    """'a', 'b' or 'on'."""
    c = cross(F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by), px, py)
    return F.when(c > 0, "a").when(c < 0, "b").otherwise("on")


def segment_distance2(e: Column, px: Column, py: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / n))).otherwise(0.0)
    ex, ey = px - (e["ax"] + t * dx), py - (e["ay"] + t * dy)
    return ex * ex + ey * ey


def side_of_polyline(points: Column, px: Column, py: Column) -> Column:
    """Side of the nearest segment; the first of equally near ones."""
    n = F.size(points)
    open_ = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    near = F.array_min(F.transform(open_, lambda e, i: F.struct(segment_distance2(e, px, py).alias("d"), i.alias("i"), cross(e["ax"], e["ay"], e["bx"], e["by"], px, py).alias("c"))))
    return F.when(near["c"] > 0, "a").when(near["c"] < 0, "b").otherwise("on")


def shoelace(points: Column) -> Column:
    """Area of a simple polygon."""
    return F.abs(F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def polyline_length(points: Column) -> Column:
    n = F.size(points)
    legs = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def meet(e: Column, f: Column) -> Column:
    """Whether two segments (struct ax, ay, bx, by) have a point in common."""
    side = lambda s, x, y: F.signum(cross(s["ax"], s["ay"], s["bx"], s["by"], x, y))
    within = lambda s, x, y: x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))
    a, b, c, d = side(f, e["ax"], e["ay"]), side(f, e["bx"], e["by"]), side(e, f["ax"], f["ay"]), side(e, f["bx"], f["by"])
    touch = ((a == 0) & within(f, e["ax"], e["ay"])) | ((b == 0) & within(f, e["bx"], e["by"])) | ((c == 0) & within(e, f["ax"], f["ay"])) | ((d == 0) & within(e, f["bx"], f["by"]))
    return ((a * b < 0) & (c * d < 0)) | touch


def without_repeats(points: Column) -> Column:
    """A closed shape's points without those that equal the one before; the last one is before the first."""
    n = F.size(points)
    return F.filter(points, lambda p, i: (n == 1) | (p != F.get(points, F.when(i == 0, n - 1).otherwise(i - 1))))


def crosses_itself(points: Column) -> Column:
    """Whether sides of a polygon that aren't next to each other meet; a point that is given twice in a row is one."""
    points = without_repeats(points)
    sides = F.transform(edges(points), lambda e, i: F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"), i.alias("i")))
    n = F.size(points)
    apart = lambda e, f: (f["i"] - e["i"] > 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
    return F.exists(sides, lambda e: F.exists(sides, lambda f: apart(e, f) & meet(e, f)))


def problems(points: Column, kind: str = "polygon") -> Column:
    """Messages about normalised points: whether there are any, their number, range, and area and crossings, or length."""
    number = lambda v: v.isNotNull() & ~F.isnan(v)
    shape = [F.when(crosses_itself(points), "crosses itself"), F.when(shoelace(points) <= 0, "no area")] if kind == "polygon" else [F.when(polyline_length(points) < 0.05, "too short")]
    return F.array_compact(
        F.array(
            F.when(points.isNull(), "no points"),
            F.when(F.size(points) < (3 if kind == "polygon" else 2), "too few points"),
            F.when(F.exists(points, lambda p: ~number(p["x"]) | ~number(p["y"])), "not a number"),
            F.when(F.exists(points, lambda p: ~p["x"].between(0, 1) | ~p["y"].between(0, 1)), "outside 0 to 1"),
            *shape,
        )
    )


def letterbox(w: Column, h: Column, to_w: int, to_h: int) -> tuple[Column, Column, Column]:
    """Scale and truncated size of a frame fitted into another."""
    r = F.least(to_w / w, to_h / h)
    return r, F.floor(w * r).cast("int"), F.floor(h * r).cast("int")


def padded(x1: Column, y1: Column, x2: Column, y2: Column, px: float, py: float, width: float, height: float) -> tuple[Column, Column, Column, Column]:
    """A box grown by shares of its sides, within the frame."""
    w, h = x2 - x1, y2 - y1
    low = lambda v: F.greatest(v, F.lit(0.0))
    return low(x1 - px * w), low(y1 - py * h), F.least(x2 + px * w, F.lit(float(width))), F.least(y2 + py * h, F.lit(float(height)))


def face(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float, share: float = 0.35) -> tuple[Column, Column, Column, Column]:
    """The upper part of a person's box, where a face is, within the frame."""
    low = lambda v: F.greatest(v, F.lit(0.0))
    return low(x1), low(y1), F.least(x2, F.lit(float(width))), F.least(y1 + share * (y2 - y1), F.lit(float(height)))


def decode(px: Column, py: Column, pw: Column, ph: Column, gx: Column, gy: Column, stride: Column, objectness: Column, classes: Column, ratio: Column) -> Column:
    """A detector's raw row as struct x1, y1, x2, y2 (in pixels of the frame), score and klass (the first of the best)."""
    cx, cy, w, h = (px + gx) * stride, (py + gy) * stride, F.exp(pw) * stride, F.exp(ph) * stride
    best = F.array_max(classes)
    sides = [((c + s * d / 2) / ratio).alias(n) for c, d, s, n in ((cx, w, -1, "x1"), (cy, h, -1, "y1"), (cx, w, 1, "x2"), (cy, h, 1, "y2"))]
    return F.struct(*sides, (objectness * best).alias("score"), (F.array_position(classes, best) - 1).cast("int").alias("klass"))


def helmet_probability(klass: Column, score: Column, threshold: float) -> Column:
    """Probability of a helmet: with one (class 0) from 0.65 to 1, with a bare head (class 1) from 0.35 to 0, by how far a score is above the threshold."""
    above = F.least(F.greatest((score - threshold) / (1 - threshold), F.lit(0.0)), F.lit(1.0))
    return F.when(klass == 0, 0.65 + 0.35 * above).when(klass == 1, 0.35 * (1 - above)).otherwise(0.5)
