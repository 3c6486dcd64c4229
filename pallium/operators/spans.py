"""Identifier spans of a text column, found and made disjoint with built-in functions only.

A pattern's matches come from regexp_extract_all and the gaps between them from split; both scan alike, so the
running length of gaps and matches gives each match's place.  Offsets count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions import catalog
from pallium.functions.matchers import CONFIDENCE_RANK, MATCHERS, Matcher
from pallium.functions.text import SCAN_LIMIT, scan_window

HIT = "struct<category:string,confidence:string,rank:int,ordinal:int,start:int,length:int,raw:string>"


def matches(text: Column, matcher: Matcher, ordinal: int) -> Column:
    """All valid matches of one matcher as an array of HIT, in order of place."""
    pattern = matcher.java
    # gaps are one more than matches: the last pair has no match
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("raw")))
    empty = F.array().cast(f"array<{HIT}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("hits"))

    def add(state, pair):
        raw = pair["raw"]
        begin = state["at"] + pair["gap"]
        hit = F.struct(
            F.lit(matcher.category).alias("category"),
            F.lit(matcher.confidence).alias("confidence"),
            F.lit(CONFIDENCE_RANK[matcher.confidence]).alias("rank"),
            F.lit(ordinal).alias("ordinal"),
            begin.alias("start"),
            F.length(raw).alias("length"),
            raw.alias("raw"),
        )
        good = raw.isNotNull() & matcher.valid(matcher.normalise(raw))
        return F.struct((begin + F.coalesce(F.length(raw), F.lit(0))).alias("at"), F.when(good, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"))

    scan = F.aggregate(pairs, start, add, lambda s: s["hits"])
    # few texts hold what a matcher needs; fewer a match; and only those are cut up
    may = F.contains(text, F.lit(matcher.needs)) if matcher.needs.isalnum() or matcher.needs == "@" else text.rlike(matcher.needs)
    return F.when(may & text.rlike(pattern), scan).otherwise(empty)


def resolve(hits: Column) -> Column:
    """Disjoint hits: strongest evidence first, then longer, then earlier, then matcher order; returned by place."""

    def before(a, b):
        key = lambda h: F.struct(-h["rank"], -h["length"], h["start"], h["ordinal"])
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    def accept(kept, hit):
        clash = F.exists(kept, lambda o: (hit["start"] < o["start"] + o["length"]) & (o["start"] < hit["start"] + hit["length"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(hit)))

    kept = F.aggregate(F.array_sort(hits, before), F.array().cast(f"array<{HIT}>"), accept)
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def find_values(
    text: Column, policy: dict[str, bool] | None = None, context: Column | None = None, admit: Column | None = None, limit: int | None = SCAN_LIMIT, scanned: bool = False
) -> Column:
    """The disjoint identifier hits of a text.

    policy: categories to look for, all by default. Loose shapes only count when `context` mentions their category or
    the array `admit` holds it. limit: characters scanned after white space is normalised; None scans all.
    scanned: the text is such a window already.
    """
    policy = catalog.normalise_policy(policy)
    window = text if scanned else scan_window(text, limit)
    none = F.array().cast(f"array<{HIT}>")
    found: dict[str, list[Column]] = {}
    for ordinal, matcher in enumerate(MATCHERS):
        if not policy[matcher.category]:
            continue
        hits = matches(window, matcher, ordinal)
        if matcher.confidence == "shape":
            allowed = F.lit(False)
            if context is not None:
                allowed = allowed | catalog.mentions(matcher.category, context)
            if admit is not None:
                allowed = allowed | F.coalesce(F.array_contains(admit, matcher.category), F.lit(False))
            # the context is only read where the text has such a shape at all
            hits = F.when(window.rlike(matcher.needs), F.when(allowed, hits).otherwise(none)).otherwise(none)
        group = "[0-9]" if "0-9]" in matcher.needs or "]0[" in matcher.needs else "@" if matcher.needs == "@" else ""
        found.setdefault(group, []).append(hits)
    # texts without a digit pass by most matchers at the price of one look
    tests = {"[0-9]": lambda: window.rlike("[0-9]"), "@": lambda: F.contains(window, F.lit("@"))}
    groups = [F.when(tests[g](), F.concat(*hits)).otherwise(none) if g else F.concat(*hits) for g, hits in found.items()]
    every = F.concat(*groups) if groups else none
    return resolve(every)


def spans(df: DataFrame, id_col: str, text_col: str = "text", **options) -> DataFrame:
    """(id_col, category, confidence, start, length, raw): one row for each hit."""
    limit = options.pop("limit", SCAN_LIMIT)
    scanned = df.withColumn(text_col, scan_window(F.col(text_col), limit))  # once, not for each matcher
    hits = scanned.select(id_col, F.explode(find_values(F.col(text_col), scanned=True, **options)).alias("h"))
    return hits.select(id_col, "h.category", "h.confidence", "h.start", "h.length", "h.raw")


def control_categories(value: Column, policy: dict[str, bool] | None = None, context: Column | None = None) -> Column:
    """Distinct (category, confidence) of a typed value; places and lengths are left out on purpose."""
    hits = find_values(value, policy, context)
    return F.array_distinct(F.transform(hits, lambda h: F.struct(h["category"], h["confidence"])))


def matcher_hits(df: DataFrame, id_col: str, category: str, text_col: str = "text", limit: int | None = SCAN_LIMIT) -> DataFrame:
    """Valid matches of one category's matchers alone, before overlaps are settled."""
    scanned = scan_window(F.col(text_col), limit)
    arrays = [matches(F.col("_scan"), m, k) for k, m in enumerate(MATCHERS) if m.category == category]
    return df.select(id_col, scanned.alias("_scan")).select(id_col, F.explode(F.concat(*arrays)).alias("h")).select(id_col, "h.start", "h.length", "h.raw")
