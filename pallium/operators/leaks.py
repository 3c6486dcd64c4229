"""Leak scan: do values of the vault occur in what goes out, exactly or reformatted?

Values meet the texts of their own scope only, by an equi-join on the scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions.text import compact

#: Shorter values are ignored; shorter compact forms are not compared.
LEAST_EXACT, LEAST_COMPACT = 4, 8
#: Characters that no text may hold by the Unicode standard: what stands for an entry until all values are replaced.
_OPEN, _DIGITS, _CLOSE = "\ufdd0", "".join(map(chr, range(0xFDD1, 0xFDDB))), "\ufddb"


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def escaped(text: Column) -> Column:
    """text as a literal inside a Java regex."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join on equal keys, null being equal to null; the keys are left's."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(other, same, how).drop(*(f"_right_{k}" for k in keys))


def leak_kind(text: Column, value: Column) -> Column:
    """'exact', 'compact' or null. Digits, set apart or not, must not be part of a longer run of digits."""
    small = compact(value)
    edge = F.lit("(?:(?<![0-9])|(?![0-9]))")  # not between two digits
    digits = lambda body: F.concat(edge, body, edge)
    exact = F.when(is_digits(small), F.rlike(text, digits(escaped(value)))).otherwise(F.contains(text, value))
    apart = F.rlike(F.lower(text), digits(F.array_join(F.split(small, ""), "[^a-z0-9ऀ-ॿ]*")))
    loose = (F.length(small) >= LEAST_COMPACT) & F.when(is_digits(small), apart).otherwise(F.contains(compact(text), small))
    return F.when((F.length(value) >= LEAST_EXACT) & exact, "exact").when((F.length(value) >= LEAST_EXACT) & loose, "compact")


def leaks(texts: DataFrame, vault: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """(scope, placeholder, category, kind): values of the vault found in a text of their scope."""
    joined = join_on(texts.select(scope, F.col(text).alias("_text")), vault, [scope])
    found = joined.withColumn("kind", leak_kind(F.col("_text"), F.col("value"))).filter("kind is not null")
    return found.groupBy(scope, "placeholder", "category").agg(F.min(F.struct((F.col("kind") == "compact").alias("o"), F.col("kind"))).alias("k")).select(scope, "placeholder", "category", "k.kind")


def _loose_pattern(value: Column) -> Column:
    """A regex for the value's compact characters with any separators between them."""
    small = compact(value)
    between = F.when(is_digits(small), F.lit(r"[\s()+.-]*")).otherwise(F.lit(f"[^a-z0-9ऀ-ॿ{_OPEN}-{_CLOSE}]*"))
    guard = F.when(is_digits(small), F.lit("[0-9]")).otherwise(F.lit("[a-z0-9ऀ-ॿ]"))
    return F.concat(F.lit("(?i)(?<!"), guard, F.lit(")"), F.array_join(F.split(small, ""), "\u0000"), F.lit("(?!"), guard, F.lit(")")), between


def redact_against(text: Column, entries: Column) -> Column:
    """text with every vault value replaced by its placeholder, exact first, then through separators.

    entries: array<struct<placeholder, value>>; longer compact values go first.  Placeholders, those already in the text
    and those put in, are marks until the end, so that no later value is found inside one.
    """

    def key(e):
        return F.struct(-F.length(compact(e["value"])), -F.length(e["value"]), e["placeholder"])

    ordered = F.array_sort(entries, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    mark = lambda i: F.concat(F.lit(_OPEN), F.translate(i.cast("string"), "0123456789", _DIGITS), F.lit(_CLOSE))
    marked = F.transform(ordered, lambda e, i: F.struct(e["placeholder"].alias("placeholder"), e["value"].alias("value"), mark(i).alias("mark")))

    def step(t, e):
        value, to = e["value"], e["mark"]
        exact = F.when(
            is_digits(value), F.regexp_replace(t, F.concat(F.lit("(?<![0-9])"), escaped(value), F.lit("(?![0-9])")), to)
        ).otherwise(F.replace(t, value, to))
        joined, between = _loose_pattern(value)
        loose = F.regexp_replace(exact, F.replace(joined, F.lit("\u0000"), between), to)
        return F.when(F.length(value) < LEAST_EXACT, t).otherwise(F.when(F.length(compact(value)) >= LEAST_COMPACT, loose).otherwise(exact))

    shown = F.aggregate(marked, text, lambda t, e: F.replace(t, e["placeholder"], e["mark"]))
    hidden = F.aggregate(marked, shown, step)
    return F.when(entries.isNull(), text).otherwise(F.aggregate(marked, hidden, lambda t, e: F.replace(t, e["mark"], e["placeholder"])))


def outbound(texts: DataFrame, vault: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """texts with `safe`, `status` and `leaked`: values of the scope's vault replaced, then scanned; a leak closes the row.

    leaked: the placeholders of the values that are still found.
    """
    entries = vault.groupBy(scope).agg(F.collect_list(F.struct("placeholder", "value")).alias("_vault"))
    rows = join_on(texts, entries, [scope], "left")
    safe = rows.withColumn("_safe", redact_against(F.col(text), F.col("_vault")))
    found = F.filter(F.coalesce("_vault", F.array().cast("array<struct<placeholder:string,value:string>>")), lambda e: leak_kind(F.col("_safe"), e["value"]).isNotNull())
    leaked = safe.withColumn("leaked", found["placeholder"])
    leaky = F.size("leaked") > 0
    return leaked.withColumns({"status": F.when(leaky, "leak").otherwise("ok"), "safe": F.when(~leaky, F.col("_safe"))}).drop("_vault", "_safe")
