"""Box arithmetic as column expressions. A box is four double columns; its convention is named by the function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def columns(prefix: str = "", names: Sequence[str] = ("x0", "y0", "x1", "y1")) -> list[Column]:
    return [F.col(prefix + n) for n in names]


def cxcywh_to_xyxy(box: Box) -> list[Column]:
    cx, cy, w, h = box
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def xyxy_to_cxcywh(box: Box) -> list[Column]:
    x0, y0, x1, y1 = box
    return [(x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0]


def xywh_to_xyxy(box: Box) -> list[Column]:
    x, y, w, h = box
    return [x, y, x + w, y + h]


def scaled(box: Box, w: Column, h: Column) -> list[Column]:
    """Multiply x by w and y by h: de-normalises a relative box, or rescales one from a padded to an output size."""
    return [box[0] * w, box[1] * h, box[2] * w, box[3] * h]


def normalised(box: Box, w: Column, h: Column) -> list[Column]:
    return [box[0] / w, box[1] / h, box[2] / w, box[3] / h]


def area(box: Box) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def _side(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def intersection(a: Box, b: Box) -> Column:
    return _side(a[0], a[2], b[0], b[2]) * _side(a[1], a[3], b[1], b[3])


def union(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def hull(a: Box, b: Box) -> Column:
    wide = F.greatest(a[2], b[2]) - F.least(a[0], b[0])
    high = F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Box, b: Box, eps: float = 1e-6) -> Column:
    """Intersection over union; with eps 0 a pair without any area gives null."""
    return F.try_divide(intersection(a, b), union(a, b) + F.lit(eps))


def giou(a: Box, b: Box, eps: float = 1e-6) -> Column:
    h = hull(a, b)
    return iou(a, b, eps) - F.try_divide(h - union(a, b), h + F.lit(eps))


def l1(a: Box, b: Box) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a[1:], b[1:])), F.abs(a[0] - b[0]))


def hflip(box: Box, width: Column) -> list[Column]:
    return [width - box[2], box[1], width - box[0], box[3]]


def clipped(box: Box, x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """The box inside a window, in the window's own coordinates."""
    zero = F.lit(0.0)
    w, h = x1 - x0, y1 - y0
    return [F.greatest(zero, F.least(box[0] - x0, w)), F.greatest(zero, F.least(box[1] - y0, h)), F.greatest(zero, F.least(box[2] - x0, w)), F.greatest(zero, F.least(box[3] - y0, h))]


def hflip_polygon(points: Column, width: Column) -> Column:
    """A flat x0,y0,x1,y1,... polygon mirrored left to right."""
    return F.transform(points, lambda v, i: F.when(i % 2 == 0, width - v).otherwise(v))


def scale_polygon(points: Column, sx: Column, sy: Column) -> Column:
    return F.transform(points, lambda v, i: F.when(i % 2 == 0, v * sx).otherwise(v * sy))


_POINTS = "array<struct<x:double,y:double>>"


def polygon_points(points: Column) -> Column:
    """A flat x0,y0,x1,y1,... polygon as an array of (x, y)."""
    n = F.floor(F.size(points) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(points, 2 * i - 1).cast("double").alias("x"), F.element_at(points, 2 * i).cast("double").alias("y")))
    return F.when(n > 0, pairs).otherwise(F.array()).cast(_POINTS)


def flat_polygon(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def _next(points: Column, i: Column) -> Column:
    """The point after the i-th (from 0), the first one after the last."""
    return F.get(points, F.pmod(i + 1, F.size(points)))


def polygon_area(points: Column) -> Column:
    """Area of a flat polygon, by the sum over its edges; 0 for fewer than three points."""
    p = polygon_points(points)
    terms = F.aggregate(F.array(p), F.array().cast("array<double>"), lambda _, q: F.transform(q, lambda a, i: a["x"] * _next(q, i)["y"] - _next(q, i)["x"] * a["y"]))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def clip_polygon(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A flat polygon inside a window, in the window's own coordinates; empty where fewer than three points remain.

    The polygon is cut by the window's four half-planes in turn, each a fold step over the edges: the inner end points
    stay, and an edge that crosses the border adds the place where it does, which is on the border and between the edge's
    ends whatever the rounding. A concave polygon that falls into several
    parts keeps edges along the border between them, which changes no area and no covered pixel centre beside them."""
    plane = lambda a, b, c: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))
    one, none = F.lit(1.0), F.lit(0.0)
    planes = F.array(plane(one, none, -x0), plane(-one, none, x1), plane(none, one, -y0), plane(none, -one, y1))  # a x + b y + c >= 0

    def cut(poly: Column, h: Column) -> Column:
        side = lambda p: h["a"] * p["x"] + h["b"] * p["y"] + h["c"]

        def edge(p: Column, i: Column) -> Column:
            q = _next(poly, i)
            s, t = side(p), side(q)
            between = lambda c: F.greatest(F.least(p[c], q[c]), F.least(F.greatest(p[c], q[c]), p[c] + (q[c] - p[c]) * s / (s - t)))
            at = F.struct(F.when(h["a"] != 0, -h["c"] * h["a"]).otherwise(between("x")).alias("x"), F.when(h["b"] != 0, -h["c"] * h["b"]).otherwise(between("y")).alias("y"))
            return F.when((s >= 0) & (t >= 0), F.array(p)).when(s >= 0, F.when(s > 0, F.array(p, at)).otherwise(F.array(p))).when(t > 0, F.array(at)).otherwise(F.array().cast(_POINTS)).cast(_POINTS)

        return F.flatten(F.transform(poly, edge)).cast(_POINTS)

    kept = F.aggregate(planes, polygon_points(points), cut)
    moved = F.transform(kept, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))
    flat = flat_polygon(moved)
    return F.when(F.size(flat) >= 6, flat).otherwise(F.array().cast("array<double>"))


def clip_polygons(parts: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The parts of an annotation inside a window; parts of which nothing remains are dropped."""
    return F.filter(F.transform(parts, lambda p: clip_polygon(p, x0, y0, x1, y1)), lambda p: F.size(p) > 0)


def shortest_edge_size(h: Column, w: Column, min_size: int, max_size: int) -> tuple[Column, Column]:
    """Height and width after the shorter side becomes min_size, unless the longer would pass max_size."""
    scale = F.lit(float(min_size)) / F.least(h, w)
    longest = F.greatest(h, w) * scale
    scale = F.when(longest > max_size, scale * F.lit(float(max_size)) / longest).otherwise(scale)
    return F.floor(h * scale + 0.5), F.floor(w * scale + 0.5)
