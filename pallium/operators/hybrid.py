"""What the elements of a page can tell and what only its pixels can: OCR plans, source comparison, pixel findings, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pallium.functions import catalog
from pallium.functions.geometry import to_image
from pallium.operators.spans import find_values

#: Brand of a sanitised picture, order of phases.
BRAND = "sanitized-screenshot-v1"
PHASES = {"observe": 0, "after": 1, "final": 2}


def surfaces(elements: DataFrame) -> DataFrame:
    """(page_id, surfaces): image, canvas and video, those of them that a page shows."""
    kinds = {"image": F.col("tag").isin("img") | (F.col("kind") == "image"), "canvas": (F.col("tag") == "canvas") | (F.col("kind") == "canvas"), "video": (F.col("tag") == "video") | (F.col("kind") == "video")}
    flags = elements.groupBy("page_id").agg(*(F.coalesce(F.bool_or(test), F.lit(False)).alias(k) for k, test in kinds.items()))
    return flags.select("page_id", F.array_compact(F.array(*(F.when(F.col(k), k) for k in kinds))).alias("surfaces"))


def ocr_plan(pages: DataFrame, shown: DataFrame, forced: bool = False) -> DataFrame:
    """(page_id, run, mode, reason) for every page; a page without elements counts as unavailable."""
    rows = pages.select("page_id").join(shown, "page_id", "left")
    gone, some = F.col("surfaces").isNull(), F.size("surfaces") > 0
    run = F.lit(forced) | gone | F.coalesce(some, F.lit(False))
    reason = F.when(F.lit(forced), "requested").when(gone, "elements unavailable").when(some, F.concat(F.array_join("surfaces", "/"), F.lit(" pixels"))).otherwise("no pixels")
    return rows.select("page_id", run.alias("run"), F.when(F.lit(forced), "forced").when(run, "automatic").otherwise("skipped").alias("mode"), reason.alias("reason"))


def comparison(elements: DataFrame, detections: DataFrame, ocr: DataFrame) -> DataFrame:
    """(page_id, signal, dom, vision): six signals of each page and who can see them.

    detections: (page_id, label); ocr: (page_id, text).
    """
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    page = elements.groupBy("page_id").agg(
        has(F.col("input_type") == "password").alias("password"), has((F.col("input_type") == "email") | F.array_contains("categories", "email")).alias("email"),
        has(F.col("kind").isin("button", "link")).alias("button"), has((F.col("kind") == "image") | (F.col("tag") == "img")).alias("image"), has((F.col("kind") == "canvas") | (F.col("tag") == "canvas")).alias("canvas"),
    )
    faces = detections.groupBy("page_id").agg(has(F.lower("label").isin("face", "person")).alias("face"))
    read = ocr.groupBy("page_id").agg(has(F.col("text").rlike(r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}")).alias("mail"), F.lit(True).alias("ocr"))
    rows = page.join(faces, "page_id", "left").join(read, "page_id", "left").na.fill(False)
    yes = lambda test, name="YES": F.when(test, name).otherwise("NO")
    table = (
        ("Password field", yes(F.col("password")), F.lit("NO")),
        ("Email field", yes(F.col("email")), yes(F.col("mail"), "MAYBE")),
        ("Person / face", F.lit("NO"), yes(F.col("face"))),
        ("Image / embedded pixels", yes(F.col("image"), "YES (tag only)"), yes(F.col("image"))),
        ("Canvas text", yes(F.col("canvas"), "YES (tag only)"), yes(F.col("ocr") & F.col("canvas"))),
        ("Normal button / link", yes(F.col("button")), F.lit("NO")),
    )
    return rows.select("page_id", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), d.alias("dom"), v.alias("vision")) for s, d, v in table))).alias("t")).select("page_id", "t.*")


def regions(elements: DataFrame, views: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(image_id, box): elements with one of the tags, in pixels. views: (image_id, width, height, view_width, view_height, offset_x, offset_y)."""
    rows = elements.filter(F.coalesce("tag", "kind").isin(*tags)).join(views, "image_id").filter("width > 0 and height > 0 and view_width > 0 and view_height > 0")
    moved = to_image(F.col("box"), *(F.col(c) for c in ("width", "height", "view_width", "view_height", "offset_x", "offset_y")))
    return rows.select("image_id", moved.alias("box"))


def annotated_items(items: DataFrame, embedded: DataFrame, canvases: DataFrame, policy: dict[str, bool] | None = None) -> DataFrame:
    """OCR items (image_id, seq, text, box) with `categories` and `level`; a region's category is only added to an item with a value."""
    on = catalog.normalise_policy(policy)
    hits = F.array_distinct(F.transform(find_values(F.col("text"), policy), lambda h: h["category"]))
    rows = items.withColumn("categories", hits)
    base = catalog.level(F.col("categories"))
    for name, where in (("image_embedded_text", embedded), ("canvas_text", canvases)):
        if not on[name]:
            continue
        r = where.select(F.col("image_id").alias("_i"), F.col("box").alias("_r"))
        cx, cy = F.col("box.x") + F.col("box.width") / 2, F.col("box.y") + F.col("box.height") / 2
        inside = (F.col("image_id") == F.col("_i")) & cx.between(F.col("_r.x"), F.col("_r.x") + F.col("_r.width")) & cy.between(F.col("_r.y"), F.col("_r.y") + F.col("_r.height"))
        met = rows.select("image_id", "seq", "box").join(r, inside, "left_semi").select("image_id", "seq", F.lit(True).alias("_in"))
        rows = rows.join(met, ["image_id", "seq"], "left")
        more = F.col("_in").isNotNull() & (F.size("categories") > 0)
        rows = rows.withColumn("categories", F.when(more, F.array_append("categories", F.lit(name))).otherwise(F.col("categories"))).drop("_in")
    plain = F.filter("categories", lambda c: ~c.isin("image_embedded_text", "canvas_text"))
    return rows.withColumn("level", catalog.level(plain))


def annotated_detections(detections: DataFrame, policy: dict[str, bool] | None = None) -> DataFrame:
    """Vision detections with `categories` and `level`: faces and people, if the policy looks for them."""
    face = F.lit(catalog.normalise_policy(policy)["faces_people"]) & F.lower("label").rlike("face|person")
    found = F.when(face, F.array(F.lit("faces_people"))).otherwise(F.array().cast("array<string>"))
    return detections.withColumns({"categories": found, "level": catalog.level(found)})


def branded(kind: Column, sanitised: Column, data_url: Column) -> Column:
    """Whether a picture carries the sanitiser's brand and is a JPEG data address."""
    return F.coalesce(sanitised & (kind == BRAND) & data_url.rlike("^data:image/jpeg;base64,[A-Za-z0-9+/=]+$"), F.lit(False))


def data_url_bytes(data_url: Column) -> Column:
    return F.floor(F.length(F.split_part(data_url, F.lit(","), F.lit(2))) * 0.75)


def frames(rows: DataFrame, session: str = "session_id") -> DataFrame:
    """The last frame of each step and phase of a session, in order. rows: (session_id, seq, step, phase, screen, captured_at, ...)."""
    phase = F.coalesce("phase", F.lit("observe"))
    key = F.coalesce(F.concat(F.lit("screen:"), F.col("screen").cast("string")), F.concat_ws(":", F.col("step").cast("string"), phase))
    newest = Window.partitionBy(session, "_key").orderBy(F.col("seq").desc())
    kept = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_key")
    rank = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))
    place = Window.partitionBy(session).orderBy(F.coalesce("step", F.lit(0)), F.coalesce(rank[phase], F.lit(0)), F.coalesce("captured_at", F.lit(0)))
    return kept.withColumn("position", F.row_number().over(place))


def frame_label(step: Column, title: Column, phase: Column) -> Column:
    start = F.concat(F.lit("Step "), F.coalesce(step.cast("string"), F.lit("?")), F.when(title != "", F.concat(F.lit(" · "), title)).otherwise(""))
    return F.when(F.coalesce(phase, F.lit("observe")) != "observe", F.concat(start, F.lit(" · after navigation"))).otherwise(start)
