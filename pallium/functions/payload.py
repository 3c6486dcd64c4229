"""Gates on what goes over the network, over JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pallium.operators.hybrid import branded

#: Keys that raw data would stand under, keys of a request, limits.
FORBIDDEN = ("vault", "original", "rawScreenshot", "rawOcr", "imageDataUrl", "profileVault", "profileValues", "sessionVault")
REQUEST_KEYS = ("sanitized", "mode", "goal", "context", "profile", "privacyManifest", "screenshot", "history", "requestId")
MAX_BYTES, MAX_GOAL, MAX_ELEMENTS, MAX_HISTORY, MAX_COUNT = 6 * 1024 * 1024, 2000, 2000, 12, 100_000
#: First delay, longest delay.
FIRST_DELAY_MS, LONGEST_DELAY_MS = 4000, 20_000


def forbidden_key(canonical: Column) -> Column:
    """Whether an object at any depth has a forbidden key. canonical: JSON from a variant, in which keys stand as "key": without blanks.

    A quotation mark inside a string is escaped there, so that a quoted name before a colon is a key.
    """
    return canonical.rlike(r'(?i)(?<!\\)"(?:' + "|".join(FORBIDDEN) + r')":')


def picture_ok(value: Column, at: str) -> Column:
    get = lambda name, kind: F.try_variant_get(value, f"{at}.{name}", kind)
    sizes = (get("width", "double") > 0) & (get("height", "double") > 0) & (get("byteLength", "double") > 0) & (get("byteLength", "double") <= MAX_BYTES)
    return branded(get("kind", "string"), get("sanitized", "boolean"), get("dataUrl", "string")) & F.coalesce(sizes, F.lit(False))


def payload_error(json: Column, needs_picture: Column | None = None) -> Column:
    """Why a payload must not be sent; null when it may."""
    v = F.try_parse_json(json)
    flag = lambda path: F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))
    shown = F.try_variant_get(v, "$.screenshot", "variant").isNotNull()
    needs = F.lit(False) if needs_picture is None else needs_picture
    return (
        F.when(v.isNull() | ~flag("$.sanitized") | ~flag("$.context.redacted"), "not sanitised")
        .when(forbidden_key(F.to_json(v)), "forbidden field")
        .when(needs & ~picture_ok(v, "$.screenshot"), "picture required")
        .when(shown & ~picture_ok(v, "$.screenshot"), "picture not branded")
        .when(F.length(F.to_json(v)) > MAX_BYTES, "too large")
    )


def request_error(json: Column) -> Column:
    """Why a planner must refuse a request; null when it may take it."""
    v = F.try_parse_json(json)
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)
    flag = lambda path: F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))
    text = F.try_variant_get(v, "$.goal", "string")
    size = lambda path: F.size(F.try_variant_get(v, path, "array<variant>"))
    counts = F.map_values(F.try_variant_get(v, "$.privacyManifest.categories", "map<string,double>"))
    fine = F.forall(counts, lambda n: n.isNotNull() & (n >= 0) & (n <= MAX_COUNT) & (n == F.floor(n)))
    tokens = F.map_values(F.try_variant_get(v, "$.profile.tokens", "map<string,string>"))
    named = F.forall(tokens, lambda t: t.rlike("^<PROFILE_[A-Z][A-Z0-9_]*>$"))
    there = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    return (
        F.when(v.isNull() | (F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0) != "OBJECT"), "not an object")
        .when(F.size(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, REQUEST_KEYS)))) > 0, "unsupported fields")
        .when(~flag("$.sanitized") | ~flag("$.context.redacted"), "not sanitised")
        .when(forbidden_key(F.to_json(v)), "forbidden field")
        .when((kind("$.goal") != "STRING") | ~F.length(text).between(1, MAX_GOAL), "goal length")
        .when((kind("$.context.elements") != "ARRAY") | (size("$.context.elements") > MAX_ELEMENTS), "elements missing or excessive")
        .when(~flag("$.privacyManifest.sanitized"), "manifest required")
        .when(there("$.privacyManifest.categories") & ~F.coalesce(fine, F.lit(False)), "manifest counts")
        .when(there("$.history") & ((kind("$.history") != "ARRAY") | (size("$.history") > MAX_HISTORY)), "history")
        .when(there("$.profile") & ~F.coalesce(named, F.lit(False)), "profile")
    )


def retry_delay_ms(header: Column, body: Column, attempt: Column) -> Column:
    """Milliseconds before another attempt: the header's seconds, the delay named in the error, or a doubling delay."""
    seconds = header.try_cast("double")
    details = F.try_variant_get(F.try_parse_json(body), "$.error.details", "array<variant>")
    named = F.transform(details, lambda d: F.regexp_extract(F.trim(F.try_variant_get(d, "$.retryDelay", "string")), r"(?i)^(\d+(?:\.\d+)?)\s*s$", 1).try_cast("double"))
    told = F.get(F.filter(named, lambda x: x.isNotNull()), 0) * 1000
    doubled = F.lit(float(FIRST_DELAY_MS)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt))
    return F.least(F.lit(float(LONGEST_DELAY_MS)), F.coalesce(F.when(seconds >= 0, seconds * 1000), told, doubled)).cast("long")
