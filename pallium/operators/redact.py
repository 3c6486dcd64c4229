"""Pseudonymisation: numbered placeholders in order of appearance, rebuilt texts, and the vault of values.

Within a scope (a page, a document, a session) equal values of a category share a placeholder; numbers count per
token; inside one string they are given from right to left.  Numbers come from a rank over first appearances, so
one scope is ordered at a time; a scope without bound should be split by the caller.  The vault is a DataFrame of
its own and holds no one-way category.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pallium.functions import catalog
from pallium.functions.text import ELLIPSIS, name_bearing, scan_window
from pallium.operators.leaks import join_on
from pallium.operators.spans import HIT, find_values

#: The text fields of an element, in the order in which they are redacted.
TEXT_FIELDS = ("text", "ariaLabel", "placeholder", "name", "htmlId", "labelFor", "alt", "href", "src")


@dataclass
class Redaction:
    texts: DataFrame  # (scope, pos, field_pos, redacted)
    records: DataFrame  # (scope, pos, field_pos, start, placeholder, category, confidence, reused, one_way)
    vault: DataFrame  # (scope, placeholder, category, value)


def strings_of(elements: DataFrame, scope: str, pos: str = "pos") -> DataFrame:
    """Element rows turned into one row for each text field: (scope, pos, field, field_pos, value)."""
    fields = [f for f in TEXT_FIELDS if f in elements.columns]
    packed = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(TEXT_FIELDS.index(f)).alias("field_pos"), F.col(f).alias("value")) for f in fields))
    rows = elements.select(scope, pos, F.explode(packed).alias("s")).select(scope, pos, "s.*")
    return rows.filter(F.col("value").isNotNull() & (F.col("value") != ""))


def fields_back(redaction: Redaction, elements: DataFrame, scope: str, pos: str = "pos") -> DataFrame:
    """elements with their text fields replaced by the redacted ones."""
    fields = [f for f in TEXT_FIELDS if f in elements.columns]
    entries = F.map_from_entries(F.collect_list(F.struct("field_pos", "redacted")))
    texts = redaction.texts.groupBy(scope, pos).agg(entries.alias("_new"))
    new = {f: F.coalesce(F.col("_new")[TEXT_FIELDS.index(f)], F.col(f)) for f in fields}
    return elements.join(texts, [scope, pos], "left").withColumns(new).drop("_new")


def redact(
    strings: DataFrame,
    scope: str,
    pos: str = "pos",
    field_pos: str = "field_pos",
    value: str = "value",
    policy: dict[str, bool] | None = None,
    context: str | None = None,
    admit: str | None = None,
    limit: int | None = None,
) -> Redaction:
    """Redact string rows. A text that ends in an ellipsis becomes one placeholder, as its end is unknown.

    limit None scans whole texts; `scan_window`'s default keeps to the first 4000 characters. Rows of the same place are
    told apart by a digest of their texts, and a null scope is a scope like any other.
    """
    strings = strings.withColumn("_text", scan_window(F.col(value), None))  # once, not for each matcher
    text = F.col("_text")
    whole = F.struct(
        F.lit("truncated_text").alias("category"),
        F.lit("truncation-guard").alias("confidence"),
        F.lit(0).alias("rank"),
        F.lit(-1).alias("ordinal"),
        F.lit(0).alias("start"),
        F.length(text).alias("length"),
        text.alias("raw"),
    )
    part = text if limit is None else F.substring("_text", 1, limit)
    hits = find_values(part, policy, F.col(context) if context else None, F.col(admit) if admit else None, scanned=True)
    rows = strings.select(scope, F.col(pos).alias("pos"), F.col(field_pos).alias("field_pos"), text.alias("text"), F.md5(text).alias("digest"), F.when(text.endswith(ELLIPSIS), F.array(whole)).otherwise(hits).cast(f"array<{HIT}>").alias("hits"))
    # explode_outer: for explode the optimiser adds a filter on the array, and so finds the hits a second time
    key = [scope, "pos", "field_pos", "digest"]
    found = rows.select(*key, F.explode_outer("hits").alias("h")).filter("h is not null").select(*key, "h.category", "h.confidence", "h.start", "h.raw")
    minted = mint(found, scope)
    entry = F.struct("start", F.length("raw").alias("length"), "placeholder")
    by_text = minted.groupBy(*key).agg(F.array_sort(F.collect_set(entry)).alias("cuts"))  # equal rows have equal cuts
    joined = join_on(rows, by_text, key, "left")
    texts = joined.select(scope, "pos", "field_pos", splice(F.col("text"), F.col("cuts")).alias("redacted"))
    vault = minted.filter(~catalog.one_way(F.col("category"))).groupBy(scope, "placeholder").agg(F.first("category").alias("category"), F.first("raw").alias("value"))
    records = minted.select(scope, "pos", "field_pos", "start", "placeholder", "category", "confidence", "reused", (catalog.one_way(F.col("category")) & ~F.col("reused")).alias("one_way"))
    return Redaction(texts, records, vault)


def mint(found: DataFrame, scope: str) -> DataFrame:
    """Hits (scope, pos, field_pos, category, confidence, start, raw) with `placeholder` and `reused`.

    A column `digest` tells texts of the same place apart.

    Two windows over hits, not texts: the first by value, the second by token within a scope.
    """
    place = [c for c in ("pos", "field_pos", "digest") if c in found.columns]
    order = F.struct(*place, (-F.col("start")).alias("right"))
    by_value = Window.partitionBy(scope, "category", "raw")
    # until the end the place is kept in one struct: all who read hits then need the same columns, and share one search
    seen = found.withColumns({"_order": order, "token": catalog.token(F.col("category"))}).drop(*place, "start")
    seen = seen.withColumn("_first", F.min("_order").over(by_value))
    ranked = seen.withColumn("_n", F.dense_rank().over(Window.partitionBy(scope, "token").orderBy("_first", "category", "raw")))
    placeholder = F.concat(F.lit("<"), F.col("token"), F.lit("_"), F.col("_n").cast("string"), F.lit(">"))
    back = {c: F.col("_order")[c] for c in place} | {"start": -F.col("_order")["right"]}
    return ranked.withColumns({"placeholder": placeholder, "reused": F.col("_order") != F.col("_first"), **back}).drop("_order", "_first", "_n", "token")


def splice(text, cuts):
    """text with each cut (start, length, placeholder), ordered by place, replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, cut):
        gap = F.substring(text, state["at"] + 1, cut["start"] - state["at"])
        return F.struct((cut["start"] + cut["length"]).alias("at"), F.concat(state["out"], gap, cut["placeholder"]).alias("out"))

    rebuilt = F.aggregate(cuts, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(cuts.isNull(), text).otherwise(rebuilt)


def summary(redaction: Redaction, scope: str) -> DataFrame:
    """Counts of a scope: placeholders, replacements, elements, recoverable values, and by category and evidence."""
    records = redaction.records
    kept = redaction.vault.groupBy(scope).agg(F.count("*").alias("recoverable"))
    totals = records.groupBy(scope).agg(
        F.count("*").alias("replacements"), F.count_distinct("pos").alias("elements"), F.count_if("one_way").alias("one_way")
    )
    out = totals.join(kept, scope, "left").withColumn("recoverable", F.coalesce("recoverable", F.lit(0)))
    for column, name in (("category", "categories"), ("confidence", "by_confidence")):
        counts = records.groupBy(scope, column).count().groupBy(scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(name))
        out = out.join(counts, scope)
    return out.withColumn("placeholders", F.col("recoverable") + F.col("one_way")).drop("one_way")


def dereference(requests: DataFrame, vault: DataFrame, scope: str) -> DataFrame:
    """requests (scope, placeholder) with `value` and `status`: found, one_way or unknown."""
    tokens = [catalog.TOKENS.get(c, c.upper()) for c in catalog.ONE_WAY]
    hidden = F.regexp_extract("placeholder", "^<([A-Z0-9_]+)_[0-9]+>$", 1).isin(*tokens)
    status = F.when(F.col("value").isNotNull(), "found").when(hidden, "one_way").otherwise("unknown")
    return requests.join(vault.select(scope, "placeholder", "value"), [scope, "placeholder"], "left").withColumn("status", status)


def _tokens(text):
    """The distinct placeholders of a text, as it stands."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("<[A-Z0-9_]+_[0-9]+>"), F.lit(0)))


def expand(text, vault, profile=None):
    """text with the placeholders of a map column replaced by their values; on a clash the profile's value counts.

    Only the placeholders of the text itself are replaced: what a value holds is put in as it is.
    """
    found = vault if profile is None else F.map_concat(F.map_filter(vault, lambda k, _: ~F.map_contains_key(profile, k)), profile)
    return _put_in(text, found)


def _put_in(text, found):
    """The text cut behind each `>`; the placeholder that ends a part gives way to its value."""
    token = lambda part: F.regexp_extract(part, "<[A-Z0-9_]+_[0-9]+>$", 0)

    def put(part):
        name = token(part)
        value = F.when(name != "", F.element_at(found, name))
        return F.when(value.isNull(), part).otherwise(F.concat(F.substring(part, F.lit(1), F.length(part) - F.length(name)), value))

    return F.array_join(F.transform(F.split(text, "(?<=>)"), put), "")


def expand_checked(text, vault, profile, profile_tokens):
    """struct<ok, skip, error, text>: `expand` with its refusals, in this order.

    A one-way placeholder and one that neither vault nor profile may know are refused; one of the profile's (the array
    profile_tokens) that has no value there skips the step; a text that already holds a value of either is refused.
    """
    tokens = _tokens(text)
    hidden = [catalog.TOKENS.get(c, c.upper()) for c in catalog.ONE_WAY]
    kind = lambda t: F.regexp_extract(t, "^<([A-Z0-9_]+)_[0-9]+>$", 1)
    one_way = F.filter(tokens, lambda t: kind(t).isin(*hidden))
    of_profile = lambda t: F.array_contains(profile_tokens, t)
    unknown = F.filter(tokens, lambda t: ~kind(t).isin(*hidden) & ~of_profile(t) & ~F.map_contains_key(vault, t))
    missing = F.filter(tokens, lambda t: ~kind(t).isin(*hidden) & of_profile(t) & ~F.map_contains_key(profile, t))
    holds = lambda entries: F.exists(F.map_values(entries), lambda v: (F.length(v) >= 4) & F.contains(text, v))
    listed = lambda ts: F.array_join(ts, ", ")
    error = (
        F.when(F.size(one_way) > 0, F.concat(F.lit("credential placeholder: "), listed(one_way)))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown placeholder: "), listed(unknown)))
        .when(F.size(missing) > 0, F.concat(F.lit("no value in the profile: "), listed(missing)))
        .when(holds(vault) | holds(profile), "the text already holds a vault value")
    )
    skip = (F.size(one_way) == 0) & (F.size(unknown) == 0) & (F.size(missing) > 0)
    return F.struct((error.isNull() | skip).alias("ok"), skip.alias("skip"), error.alias("error"), F.when(error.isNull(), expand(text, vault, profile)).alias("text"))


def texts_for_model(elements: DataFrame, scope: str, pos: str = "pos") -> DataFrame:
    """(scope, key, pos, field, value): the texts in which a model may look for names, under stable keys.

    Addresses of links and pictures are left out, and so is what holds only placeholders.
    """
    rows = strings_of(elements, scope, pos).filter(~F.col("field").isin("href", "src"))
    key = F.concat_ws(".", F.lit("el"), F.col(pos).cast("string"), F.col("field"))
    return rows.filter(name_bearing(F.col("value"))).select(scope, key.alias("key"), pos, "field", "field_pos", "value")


def apply_entities(first: Redaction, entities: DataFrame, scope: str, policy: dict[str, bool] | None = None) -> Redaction:
    """A second round over redacted texts: model entities (scope, pos, field_pos, category, start, length, score) get placeholders too.

    Values that the first vault knows keep their placeholder; new numbers go on after the first round's.
    """
    on = [c for c, yes in catalog.normalise_policy(policy).items() if yes]
    texts = first.texts.withColumnRenamed("redacted", "_text")
    found = entities.filter(F.col("category").isin(*on)).join(texts, [scope, "pos", "field_pos"])
    raw = F.substring(F.col("_text"), F.col("start") + 1, F.col("length"))
    found = found.select(scope, "pos", "field_pos", "category", F.lit("model").alias("confidence"), "start", "length", raw.alias("raw"))
    known = first.vault.select(scope, "category", F.col("value").alias("raw"), F.col("placeholder").alias("_known"))
    number = F.regexp_extract("placeholder", "_([0-9]+)>$", 1).cast("int")
    used = first.records.groupBy(scope, catalog.token(F.col("category")).alias("_token")).agg(F.max(number).alias("_used"))
    old = found.join(known, [scope, "category", "raw"]).withColumns({"placeholder": F.col("_known"), "reused": F.lit(True)}).drop("_known")
    new = mint(found.join(known, [scope, "category", "raw"], "left_anti"), scope).withColumn("_token", catalog.token(F.col("category")))
    shifted = (F.regexp_extract("placeholder", "_([0-9]+)>$", 1).cast("int") + F.coalesce("_used", F.lit(0))).cast("string")
    new = new.join(used, [scope, "_token"], "left").withColumn("placeholder", F.concat(F.lit("<"), F.col("_token"), F.lit("_"), shifted, F.lit(">")))
    minted = old.unionByName(new.select(*old.columns))
    cuts = minted.groupBy(scope, "pos", "field_pos").agg(F.array_sort(F.collect_list(F.struct("start", "length", "placeholder"))).alias("_cuts"))
    done = texts.join(cuts, [scope, "pos", "field_pos"], "left").select(scope, "pos", "field_pos", splice(F.col("_text"), F.col("_cuts")).alias("redacted"))
    more = minted.select(scope, "pos", "field_pos", "start", "placeholder", "category", "confidence", "reused", (catalog.one_way(F.col("category")) & ~F.col("reused")).alias("one_way"))
    vault = minted.filter(~F.col("reused") & ~catalog.one_way(F.col("category"))).select(scope, "placeholder", "category", F.col("raw").alias("value"))
    return Redaction(done, first.records.unionByName(more), first.vault.unionByName(vault))
