"""Text columns with the white space and word borders of ECMAScript regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that \s and trim() stand for in ECMAScript.
WHITE = r"\u0009-\u000D\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Runs of white space that are not a single blank already: only these need to be replaced by one.
_RUNS = f"[{WHITE}&&[^ ]][{WHITE}]*| [{WHITE}]+"
WORD = "[A-Za-z0-9_]"
#: \b over ASCII words; Java's own \b also counts letters beyond ASCII.
BORDER = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
ELLIPSIS = "…"
#: Fixed value: longest text of an element before it is cut.
TEXT_LIMIT = 280
#: Fixed value: characters of a text that are scanned for identifiers.
SCAN_LIMIT = 4000


def java(pattern: str, ignore_case: bool = False) -> str:
    """A Java regex for an ECMAScript pattern written with \\b, \\s and \\d."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            swap = {"\\s": WHITE if inside else f"[{WHITE}]", "\\S": f"[^{WHITE}]", "\\b": BORDER}
            out.append(swap.get(pair, pair))
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def normalize(text: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " "))


def truncate(text: Column, limit: int = TEXT_LIMIT) -> Column:
    return cut(normalize(text), limit)


def cut(flat: Column, limit: int = TEXT_LIMIT) -> Column:
    """A normalised text, with an ellipsis for what is beyond the limit."""
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit(ELLIPSIS))).otherwise(flat)


def scan_window(text: Column, limit: int | None = SCAN_LIMIT) -> Column:
    """The part of a text that is scanned; all of it when limit is None."""
    flat = normalize(text)
    return flat if limit is None else F.substring(flat, 1, limit)


def blank_to_null(text: Column) -> Column:
    """Null for a text that is empty once it is normalised."""
    return F.when(text.rlike(f"[^{WHITE}]"), text)


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def haystack(*texts: Column) -> Column:
    """Non-empty texts joined by blanks."""
    return F.concat_ws(" ", *(empty_to_null(t) for t in texts))


def compact(text: Column) -> Column:
    """Lower case without separators, for comparing reformatted values."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9ऀ-ॿ]", "")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def upper_compact(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, f"[{WHITE}-]", ""))


def strip_fence(text: Column) -> Column:
    """The inside of a fenced code block, or the text itself, trimmed."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(F.trim(text).rlike(r"(?s)^```(?:json)?\s*.*?\s*```$"), inner).otherwise(F.trim(text))


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))


def name_bearing(text: Column) -> Column:
    """Whether a model for names has something to read: a Latin or Devanagari letter, and two characters beside placeholders."""
    rest = normalize(F.regexp_replace(text, "<[A-Z][A-Z0-9_]*>", " "))
    return F.coalesce(text.rlike("[A-Za-zऀ-ॿ]") & (F.length(rest) >= 2), F.lit(False))


def mask_value(value: Column) -> Column:
    """What is shown of a saved value: its last four characters."""
    return F.when(F.length(value) > 4, F.concat(F.lit("saved · …"), F.right(value, F.lit(4)))).otherwise(F.lit("saved"))


def page_identity(tab: Column, url: Column) -> Column:
    """A page is its tab and its address without fragment."""
    return F.concat_ws("|", tab.cast("string"), F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)))


def compact_src(url: Column) -> Column:
    """Origin and path of an address; null for data addresses and what doesn't parse."""
    kept = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), F.try_parse_url(url, F.lit("PATH")))
    return F.when(~url.startswith("data:"), kept)


def placeholders_in(text: Column) -> Column:
    """Distinct placeholders of a text: element tokens, then profile tokens."""
    tokens = F.regexp_extract_all(text, F.lit("<[A-Z][A-Z0-9_]*_[0-9]+>"), F.lit(0))
    profile = F.regexp_extract_all(text, F.lit("<PROFILE_[A-Z0-9_]+>"), F.lit(0))
    return F.array_distinct(F.concat(tokens, profile))
