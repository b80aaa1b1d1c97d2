"""Boxes: bounding boxes, the widest ones, and crops around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_digit


def bounding_box(polygon: Column, sx: Column, sy: Column, ox: Column, oy: Column) -> Column:
    """x0, y0, x1, y1 of a polygon (array of x, y), scaled and shifted, cut to whole numbers."""
    xs, ys = F.transform(polygon, lambda p: p[0] * sx + ox), F.transform(polygon, lambda p: p[1] * sy + oy)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).cast("array<int>")


def widest(boxes: DataFrame, n: int = 6, by: tuple[str, ...] = ("image_id",), width: Column | None = None, order: tuple[str, ...] = ("stage_ord", "box_seq")) -> DataFrame:
    """Of every image the n widest boxes, of equals the earlier; place from 1."""
    w = width if width is not None else F.get("box", F.lit(2)) - F.get("box", F.lit(0))
    return boxes.withColumn("_w", w).withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.col("_w").desc(), *order))).where(F.col("place") <= n).drop("_w")


def crop_boxes(boxes: DataFrame, n: int = 6) -> DataFrame:
    """image_id, crop (array x0, y0, x1, y1) and place of the crops to read again: around the widest boxes with a digit, or the widest if none has one; those too small are left out. Wants width and height of the image."""
    marked = boxes.withColumn("_d", has_digit(F.col("text")))
    any_ = F.max(F.col("_d").cast("int")).over(W.partitionBy("image_id")) == 1
    wide = widest(marked.withColumn("_any", any_).where(~F.col("_any") | F.col("_d")), n)
    x0, y0, x1, y1 = (F.get("box", F.lit(i)) for i in range(4))
    pw, ph = (x1 - x0) * 0.35 + 12, (y1 - y0) * 0.9 + 12
    cut = wide.select("image_id", F.array(F.greatest(F.lit(0), (x0 - pw).cast("int")), F.greatest(F.lit(0), (y0 - ph).cast("int")), F.least("width", (x1 + pw).cast("int")), F.least("height", (y1 + ph).cast("int"))).alias("crop"), "place")
    big = (F.get("crop", F.lit(2)) - F.get("crop", F.lit(0)) >= 12) & (F.get("crop", F.lit(3)) - F.get("crop", F.lit(1)) >= 8)
    return cut.where(big).withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy("place")))
