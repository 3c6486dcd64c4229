"""The relational half of named-entity recognition: windows over texts, packs, token groups, merging.

A model is a plug-in that turns texts into token rows (text_id, idx, tag, score, start, end); `gazetteer_tokens`
is a deterministic stand-in with the same schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Window and overlap in characters, separator of packs, least score, label to category.
CHUNK, OVERLAP = 1200, 160
SEPARATOR = "\n\n"
LEAST_SCORE = 0.9
LABELS = {"PER": "person_name"}
PLACEHOLDER = "<[A-Z][A-Z0-9_]*>"


def windows(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(offset, window): windows of at most `size`, cut at a blank in their last quarter where there is one."""
    text, start = text or "", 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            blank = text.rfind(" ", 0, end + 1)
            if blank > start + size * 3 // 4:
                end = blank
        yield start, text[start:end]
        if end >= len(text):
            return
        start = end - overlap if end - overlap > start else end


def chunked(df: DataFrame, id_col: str, text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, chunk, offset, text) of every text; where a window starts depends on where the last one ended."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [(row, k, o, w) for row, t in enumerate(part.column(1).to_pylist()) for k, (o, w) in enumerate(windows(t, size, overlap))]
                rows, k, offset, text = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(k, pa.int32()), pa.array(offset, pa.int32()), pa.array(text, pa.string())],
                    ["id", "chunk", "offset", "text"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, chunk int, offset int, text string")
    return out.withColumnRenamed("id", id_col)


def packs_of(items: list[tuple[str, str]], size: int = CHUNK, separator: str = SEPARATOR) -> Iterator[tuple[str, list[tuple[str, int, int, int]]]]:
    """(text, members (key, start, source start, length)): short texts share a pack, long ones get windows of their own."""
    texts: list[str] = []
    members: list[tuple[str, int, int, int]] = []
    used = 0
    for key, text in items:
        if not text:
            continue
        alone = len(text) > size
        if members and (alone or used + len(separator) + len(text) > size):
            yield separator.join(texts), members
            texts, members, used = [], [], 0
        if alone:
            for offset, window in windows(text, size):
                yield window, [(key, 0, offset, len(window))]
            continue
        start = used + len(separator) if members else 0
        members.append((key, start, 0, len(text)))
        texts.append(text)
        used = start + len(text)
    if members:
        yield separator.join(texts), members


def packed(texts: DataFrame, scope: str, key: str = "key", order: str = "pos", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(scope, pack, text, members) for the texts of each scope, in order. A scope is a page; its texts meet in one task."""
    kind = texts.schema[scope].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["order"])
        made = list(packs_of([(r["key"], r["text"]) for r in rows], size))
        names = ("key", "start", "source_start", "length")
        member = pa.list_(pa.struct([("key", pa.string()), ("start", pa.int32()), ("source_start", pa.int32()), ("length", pa.int32())]))
        return pa.table(
            {
                "scope": pa.array([rows[0]["scope"]] * len(made), table.schema.field("scope").type),
                "pack": pa.array(range(len(made)), pa.int32()),
                "text": pa.array([t for t, _ in made], pa.string()),
                "members": pa.array([[dict(zip(names, m)) for m in ms] for _, ms in made], member),
            }
        )

    rows = texts.select(F.col(scope).alias("scope"), F.col(key).cast("string").alias("key"), F.col(order).alias("order"), F.col(text).alias("text"))
    out = rows.groupBy("scope").applyInArrow(run, f"scope {kind}, pack int, text string, members array<struct<key:string,start:int,source_start:int,length:int>>")
    return out.withColumnRenamed("scope", scope)


def unpacked(entities: DataFrame, packs: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of packs moved back to the member that holds them whole; the first such member counts."""
    joined = entities.join(packs.select(*keys, "members"), keys)
    end = F.col("start") + F.col("length")
    owner = F.filter("members", lambda m: (F.col("start") >= m["start"]) & (end <= m["start"] + m["length"]))
    found = joined.withColumn("owner", F.get(owner, 0)).filter("owner is not null")
    return found.withColumns({"key": F.col("owner.key"), "start": F.col("start") - F.col("owner.start") + F.col("owner.source_start")}).drop("owner", "members")


def entity_groups(tokens: DataFrame, texts: DataFrame, text_id: str = "text_id", text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(text_id, label, category, score, start, length, text): runs of tokens of one type.

    A token goes on with the group before it only by an I- tag of the same type that doesn't step back; an I- tag
    without such a group starts one. The weakest token gives the group's score; groups over a placeholder go.
    """
    order = Window.partitionBy(text_id).orderBy("idx")
    kind = F.upper(F.regexp_replace("tag", "(?i)^[BILUES]-", ""))
    outside = F.col("tag").isNull() | (F.col("tag") == "O") | (kind == "") | F.col("start").isNull() | F.col("end").isNull()
    rows = tokens.withColumns({"type": kind, "out": outside})
    joins = (~F.lag("out", 1, True).over(order)) & (F.lag("type").over(order) == F.col("type")) & F.col("tag").rlike("(?i)^I-") & (F.col("start") >= F.lag("start").over(order))
    rows = rows.withColumn("starts", F.col("out") | ~F.coalesce(joins, F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.col("starts").cast("int")).over(order)).filter(~F.col("out"))
    groups = rows.groupBy(text_id, "island", F.col("type").alias("label")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.coalesce("score", F.lit(0.0))).alias("score")
    )
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    groups = groups.withColumn("category", labels[F.col("label")]).filter(F.col("category").isNotNull() & (F.col("score") >= least) & (F.col("end") > F.col("start")))
    joined = groups.join(texts.select(text_id, F.col(text).alias("_text")), text_id)
    kept = joined.filter(~F.exists(placeholder_ranges(F.col("_text")), lambda r: (F.col("start") < r["to"]) & (F.col("end") > r["from"])))
    length = F.col("end") - F.col("start")
    return kept.select(text_id, "label", "category", F.round("score", 4).alias("score"), "start", length.alias("length"), F.substring("_text", F.col("start") + 1, length).alias("text"))


def placeholder_ranges(text: Column) -> Column:
    """array<struct<from, to>> of the placeholders in a text."""
    pairs = F.zip_with(F.split(text, PLACEHOLDER, -1), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n")))
    none = F.array().cast("array<struct<from:int,to:int>>")

    def step(state, pair):
        begin = state["at"] + pair["gap"]
        end = begin + F.coalesce(pair["n"], F.lit(0))
        more = F.concat(state["r"], F.array(F.struct(begin.alias("from"), end.alias("to"))))
        return F.struct(end.alias("at"), F.when(pair["n"].isNull(), state["r"]).otherwise(more).alias("r"))

    scan = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("r")), step, lambda s: s["r"])
    return F.when(text.rlike(PLACEHOLDER), scan).otherwise(none)


def merged(entities: DataFrame, text_id: str = "text_id") -> DataFrame:
    """One entity for each span and category, the best score of it, without those inside a longer one of their category."""
    best = entities.groupBy(text_id, "category", "start", "length").agg(F.max("score").alias("score"))
    b = best.select(text_id, "category", F.col("start").alias("_s"), F.col("length").alias("_l"))
    inside = (F.col("_s") <= F.col("start")) & (F.col("_s") + F.col("_l") >= F.col("start") + F.col("length")) & (F.col("_l") > F.col("length"))
    bigger = best.join(b, [text_id, "category"]).filter(inside).select(text_id, "category", "start", "length").distinct()
    return best.join(bigger, [text_id, "category", "start", "length"], "left_anti")


def gazetteer_tokens(texts: DataFrame, names: list[str], text_id: str = "text_id", text: str = "text") -> DataFrame:
    """Token rows of a stand-in model that knows a list of words: B-PER for the first of a run, I-PER for the rest."""
    word = r"[\p{L}]+"
    pairs = F.zip_with(F.split(text, word, -1), F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("word")))
    order = Window.partitionBy(text_id).orderBy("idx")
    rows = texts.select(text_id, F.posexplode(pairs).alias("idx", "t")).select(text_id, "idx", "t.*").filter("word is not null")
    end = F.sum(F.col("gap") + F.length("word")).over(order).cast("int")
    known = F.col("word").isin(*names)
    before = F.coalesce(F.lag(known).over(order), F.lit(False))
    tag = F.when(~known, "O").when(before, "I-PER").otherwise("B-PER")
    return rows.select(text_id, "idx", tag.alias("tag"), F.lit(0.99).alias("score"), (end - F.length("word")).alias("start"), end.alias("end"))
