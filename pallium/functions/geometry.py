"""Boxes as columns: struct<x, y, width, height> of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"
#: Padding of high-risk and other categories as share and pixels, and the largest share of an image.
HIGH_RISK = ("password", "otp", "cvv", "payment_card", "bank_account", "authentication_secret", "aadhaar", "pan", "passport", "security_pin")
PAD_HIGH, PAD_OTHER = (0.12, 8.0), (0.07, 5.0)
LARGEST_SHARE = 0.4
#: Overlap from which the weaker of two detections goes; faces' score, side, aspect and area.
SUPPRESS_IOU = 0.3
FACE_SCORE, FACE_SIDE, FACE_ASPECT, FACE_AREA = 0.57, 16.0, (0.45, 1.35), 0.45


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def to_image(b: Column, image_width: Column, image_height: Column, view_width: Column, view_height: Column, offset_x: Column, offset_y: Column) -> Column:
    """A box in page units moved to pixels of an image of the visual viewport."""
    sx, sy = image_width / view_width, image_height / view_height
    return box((b["x"] - offset_x) * sx, (b["y"] - offset_y) * sy, b["width"] * sx, b["height"] * sy)


def clamp(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels inside the image; null when nothing is left."""
    x0, y0 = F.greatest(F.lit(0.0), F.floor(b["x"]).cast("double")), F.greatest(F.lit(0.0), F.floor(b["y"]).cast("double"))
    x1 = F.least(width.cast("double"), F.ceil(b["x"] + b["width"]).cast("double"))
    y1 = F.least(height.cast("double"), F.ceil(b["y"] + b["height"]).cast("double"))
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


def pad(b: Column, category: Column, width: Column, height: Column) -> Column:
    high = category.isin(*HIGH_RISK)

    def by(side: Column) -> Column:
        return F.when(high, F.greatest(side * PAD_HIGH[0], F.lit(PAD_HIGH[1]))).otherwise(F.greatest(side * PAD_OTHER[0], F.lit(PAD_OTHER[1])))

    px, py = by(b["width"]), by(b["height"])
    return clamp(box(b["x"] - px, b["y"] - py, b["width"] + 2 * px, b["height"] + 2 * py), width, height)


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def covers_too_much(b: Column, width: Column, height: Column) -> Column:
    return area(b) > LARGEST_SHARE * width * height


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def touches(a: Column, b: Column) -> Column:
    """Overlap that counts a shared edge."""
    across = (a["x"] <= b["x"] + b["width"]) & (b["x"] <= a["x"] + a["width"])
    return across & (a["y"] <= b["y"] + b["height"]) & (b["y"] <= a["y"] + a["height"])


def plausible_face(b: Column, score: Column, width: Column, height: Column) -> Column:
    aspect = b["width"] / b["height"]
    large = (b["width"] >= FACE_SIDE) & (b["height"] >= FACE_SIDE)
    return (score >= FACE_SCORE) & large & aspect.between(*FACE_ASPECT) & (area(b) <= FACE_AREA * width * height)


def tile_starts(total: Column, tile: int) -> Column:
    """Starts of overlapping tiles that cover `total`: three quarters of a tile apart, the last one flush."""
    step = int(tile * 0.75)
    last = total - tile
    return F.when(total <= tile, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), total, F.lit(step)), lambda s: s < last), F.array(last)))
    )


def scale_to(width: Column, height: Column, edge: int = 1600) -> Column:
    """Factor that brings the longer edge down to `edge`."""
    return F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
