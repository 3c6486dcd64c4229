"""Operators over detections: (image_id, seq, category, source, policy, confidence, box)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions.geometry import BOX, FACE_SCORE, SUPPRESS_IOU, box, covers_too_much, iou, pad, plausible_face, touches


def normalised(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Detections padded, cut to their image (image_id, width, height), confidence within 0 and 1; too large or empty ones go."""
    joined = detections.join(images, "image_id")
    padded = joined.withColumn("box", pad(F.col("box"), F.col("category"), F.col("width"), F.col("height")))
    kept = padded.filter(F.col("box").isNotNull() & ~covers_too_much(F.col("box"), F.col("width"), F.col("height")))
    return kept.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), 4)).drop("width", "height")


def union_sources(dom: DataFrame, ocr: DataFrame, vision: DataFrame) -> DataFrame:
    return dom.unionByName(ocr, allowMissingColumns=True).unionByName(vision, allowMissingColumns=True)


def non_maximum_suppression(detections: DataFrame, by: tuple[str, ...] = ("image_id",), threshold: float = SUPPRESS_IOU) -> DataFrame:
    """Detections by falling confidence, without those that overlap a kept one; a fold over each image's few boxes."""
    item = F.struct((-F.col("confidence")).alias("neg"), "seq", "box", "category")
    kind = f"array<struct<neg:double,seq:{detections.schema['seq'].dataType.simpleString()},box:{BOX},category:string>>"
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.array().cast(kind),
        lambda acc, d: F.when(F.exists(acc, lambda o: iou(o["box"], d["box"]) >= threshold), acc).otherwise(F.concat(acc, F.array(d))),
    )
    rows = detections.groupBy(*by).agg(kept.alias("kept")).select(*by, F.explode("kept").alias("d"))
    return rows.select(*by, F.col("d.seq").alias("seq"), F.col("d.category").alias("category"), (-F.col("d.neg")).alias("confidence"), F.col("d.box").alias("box"))


def _union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, low = F.greatest(a["x"] + a["width"], b["x"] + b["width"]), F.greatest(a["y"] + a["height"], b["y"] + b["height"])
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (low - y).alias("height"), (a["n"] + b["n"]).alias("n"))


def merged(detections: DataFrame) -> DataFrame:
    """(image_id, category, box, n): boxes that touch, directly or through others, as one bounding box for each category.

    A fold over an image's few boxes: a new box swallows what it touches until it touches nothing more.
    """
    group = "struct<x:double,y:double,width:double,height:double,n:int>"

    def swallow(state: Column, new: Column) -> Column:
        start = F.struct(new.alias("b"), state.alias("rest"))

        def again(s, _):
            hit = F.filter(s["rest"], lambda g: touches(g, s["b"]))
            grown = F.aggregate(hit, s["b"], _union)
            return F.struct(grown.alias("b"), F.filter(s["rest"], lambda g: ~touches(g, s["b"])).alias("rest"))

        return F.aggregate(F.sequence(F.lit(0), F.size(state)), start, again, lambda s: F.concat(s["rest"], F.array(s["b"])))

    boxes = F.collect_list(F.struct("box.x", "box.y", "box.width", "box.height", F.lit(1).alias("n")))
    rows = detections.groupBy("image_id", "category").agg(F.array_sort(boxes).cast(f"array<{group}>").alias("all"))
    groups = F.when(F.size("all") < 2, F.col("all")).otherwise(F.aggregate("all", F.array().cast(f"array<{group}>"), swallow))
    out = rows.select("image_id", "category", F.explode(groups).alias("g"))
    return out.select("image_id", "category", box(*(F.col(f"g.{k}") for k in ("x", "y", "width", "height"))).alias("box"), F.col("g.n").alias("n"))


def manifest(detections: DataFrame) -> DataFrame:
    """Counts of an image's masks by category, source and policy, without any content."""
    out = detections.groupBy("image_id").agg(F.count("*").alias("detections"), F.count_if(F.col("policy") == "black").alias("black_regions"))
    for column, name in (("category", "categories"), ("source", "sources"), ("policy", "policies")):
        counts = detections.groupBy("image_id", F.coalesce(column, F.lit("unknown")).alias(column)).count()
        out = out.join(counts.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(name)), "image_id")
    return out


def texts_in_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """OCR items whose centre lies in a region of their image: (image_id, region box) as a semi join."""
    r = regions.select("image_id", F.col("box").alias("_r"))
    cx, cy = F.col("box.x") + F.col("box.width") / 2, F.col("box.y") + F.col("box.height") / 2
    inside = (cx >= F.col("_r.x")) & (cx <= F.col("_r.x") + F.col("_r.width")) & (cy >= F.col("_r.y")) & (cy <= F.col("_r.y") + F.col("_r.height"))
    return items.join(r, (items["image_id"] == r["image_id"]) & inside, "left_semi")


#: Edge of a face detector's input, its strides.
INPUT_EDGE, STRIDES = 640, (8, 16, 32)


def decoded_faces(cells: DataFrame, least: float = FACE_SCORE, edge: int = INPUT_EDGE) -> DataFrame:
    """Detections of a grid detector's outputs, (image_id, stride, idx, cls, obj, bbox array of dx, dy, log w, log h) a cell."""
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    per_row = edge / F.col("stride")
    cx, cy = (F.col("idx") % per_row + F.get("bbox", F.lit(0))) * F.col("stride"), (F.floor(F.col("idx") / per_row) + F.get("bbox", F.lit(1))) * F.col("stride")
    w, h = F.exp(F.get("bbox", F.lit(2))) * F.col("stride"), F.exp(F.get("bbox", F.lit(3))) * F.col("stride")
    rows = cells.filter(F.col("stride").isin(*STRIDES)).withColumn("confidence", F.sqrt(inside("cls") * inside("obj"))).filter(F.col("confidence") >= least)
    return rows.select("image_id", F.xxhash64("stride", "idx").alias("seq"), F.lit("faces_people").alias("category"), F.lit("vision").alias("source"), "confidence", box(cx - w / 2, cy - h / 2, w, h).alias("box"))


def corner_boxes(rows: DataFrame) -> DataFrame:
    """rows with `box` in whole pixels from corners (xmin, ymin, xmax, ymax), or from a place and a size where corners are missing."""
    x0, y0 = F.coalesce("xmin", "x", F.lit(0.0)), F.coalesce("ymin", "y", F.lit(0.0))
    x1, y1 = F.coalesce(F.col("xmax"), x0 + F.coalesce("width", F.lit(0.0))), F.coalesce(F.col("ymax"), y0 + F.coalesce("height", F.lit(0.0)))
    return rows.withColumn("box", box(F.round(x0), F.round(y0), F.round(F.greatest(F.lit(0.0), x1 - x0)), F.round(F.greatest(F.lit(0.0), y1 - y0))))


def ocr_items(pages: DataFrame) -> DataFrame:
    """(image_id, seq, text, confidence, box): the lines of nested OCR results, without blank ones; confidence from per cent.

    pages: (image_id, blocks: array of paragraphs: array of lines: array of struct<text, confidence, bbox: struct<x0, y0, x1, y1>>).
    """
    lines = F.flatten(F.transform("blocks", lambda b: F.flatten(F.transform(b["paragraphs"], lambda p: p["lines"]))))
    rows = pages.select("image_id", F.posexplode(lines).alias("seq", "line")).withColumn("text", F.trim("line.text")).filter("text <> ''")
    b = F.col("line.bbox")
    return rows.select("image_id", "seq", "text", (F.col("line.confidence") / 100).alias("confidence"), box(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]).alias("box"))


def plausible_faces(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Face detections that can be faces by score, size, shape and share of their image (image_id, width, height)."""
    joined = detections.join(images, "image_id")
    return joined.filter(plausible_face(F.col("box"), F.col("confidence"), F.col("width"), F.col("height"))).drop("width", "height")
