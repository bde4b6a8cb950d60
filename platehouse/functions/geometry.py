"""Boxes, lines and polygons as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(x1: Column, y1: Column, x2: Column, y2: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """Area common to two corner boxes."""
    return F.greatest(F.lit(0.0), F.least(x2, u2) - F.greatest(x1, u1)) * F.greatest(F.lit(0.0), F.least(y2, v2) - F.greatest(y1, v1))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two corner boxes; 0 where the union is empty."""
    common = overlap(*a, *b)
    area = lambda x1, y1, x2, y2: F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)
    union = area(*a) + area(*b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def corners(box: Column) -> tuple[Column, ...]:
    """Corners of an array [x, y, width, height]."""
    return box[0], box[1], box[0] + box[2], box[1] + box[3]


def signed_side(x: Column, y: Column, line: tuple[tuple[float, float], tuple[float, float]]) -> Column:
    """Above 0 on one side of a directed line, below 0 on the other."""
    (ax, ay), (bx, by) = line
    return F.lit(bx - ax) * (y - F.lit(ay)) - F.lit(by - ay) * (x - F.lit(ax))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule: an odd number of edges lie to the point's right."""
    inside = F.lit(False)
    for (px, py), (cx, cy) in zip([polygon[-1], *polygon[:-1]], polygon, strict=True):
        at = F.lit((px - cx) / ((py - cy) or 1e-12)) * (y - F.lit(cy)) + F.lit(cx)
        inside = inside != (((F.lit(cy) > y) != (F.lit(py) > y)) & (x < at))
    return inside


def clip(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """A box inside a frame, as a struct of corners."""
    fit = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most)))
    return F.struct(fit(x1, width).alias("x1"), fit(y1, height).alias("y1"), fit(x2, width).alias("x2"), fit(y2, height).alias("y2"))
