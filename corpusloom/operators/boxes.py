"""Boxes of page elements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1000


def corners(box: Column) -> Column:
    """(x, y, width, height) as (left, top, right, bottom)."""
    return F.array(box[0], box[1], box[0] + box[2], box[1] + box[3])


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """Corners in thousandths of the page, whole, within it, and in order; sides under 1 count as 1."""
    at = lambda v, size: F.least(F.greatest(v * SCALE / F.greatest(size, F.lit(1)), F.lit(0)), F.lit(SCALE)).cast("int")
    x0, y0, x1, y1 = at(box[0], width), at(box[1], height), at(box[2], width), at(box[3], height)
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def page_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Every (x, y, width, height) of a page in normal form."""
    return F.transform(boxes, lambda b: normal_box(corners(b), width, height))


def reading_order(blocks: Column) -> Column:
    """An array of blocks with x and y, from top to bottom, then from left to right."""
    return F.transform(F.array_sort(F.transform(blocks, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b.alias("b")))), lambda s: s["b"])
