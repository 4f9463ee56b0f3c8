"""Detector geometry: letterbox, best anchor, box decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.schemas import DEFAULTS, Settings


def letterbox(width: Column, height: Column, size: int = DEFAULTS.input_size) -> Column:
    """Scale, new width and height (half to even) and padding of an image in a square of ``size``."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    wide, high = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return F.struct(scale.alias("scale"), wide.alias("new_w"), high.alias("new_h"), F.floor((F.lit(size) - wide) / 2).cast("int").alias("pad_x"), F.floor((F.lit(size) - high) / 2).cast("int").alias("pad_y"))


def best_anchor(anchors: DataFrame, image: str, confidence: str = "conf", index: str = "anchor") -> DataFrame:
    """Each image's anchor of most confidence, the first of equal ones."""
    place = F.row_number().over(Window.partitionBy(image).orderBy(F.desc(confidence), index))
    return anchors.withColumn("__place", place).filter(F.col("__place") == 1).drop("__place")


def decode_box(cx: Column, cy: Column, w: Column, h: Column, conf: Column, width: Column, height: Column, settings: Settings = DEFAULTS) -> Column:
    """Corners in the image of a box in the letterboxed square, widened by the margin, and the error code if any."""
    box = letterbox(width, height, settings.input_size)
    scale, pad_x, pad_y = box["scale"], box["pad_x"], box["pad_y"]
    left, top = (cx - w / 2 - pad_x) / scale, (cy - h / 2 - pad_y) / scale
    right, bottom = (cx + w / 2 - pad_x) / scale, (cy + h / 2 - pad_y) / scale
    more_x, more_y = (right - left) * settings.box_margin, (bottom - top) * settings.box_margin
    fit = lambda value, most: F.greatest(F.lit(0), F.least(F.bround(value).cast("int"), most.cast("int")))
    x1, y1, x2, y2 = fit(left - more_x, width), fit(top - more_y, height), fit(right + more_x, width), fit(bottom + more_y, height)
    error = F.when(conf < settings.confidence, "no_invoice_detected").when((x2 <= x1) | (y2 <= y1), "yolo_degenerate_box")
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), error.alias("error_code"))
