"""Authentication gates: fields that only the person may fill, and what a page of them means for a session.

elements: (page_id, pos, tag, kind, input_type, autocomplete, text, placeholder, name, html_id, aria_label, categories, has_value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions.text import haystack, java

#: Wordings of a security PIN and of a one-time code, hard kinds, labels, input types that are no digit box.
PIN_WORDS = (r"security\s*pin", r"6[\s-]?digit\s+(?:security\s+)?pin", r"\b(?:m[\s-]?pin|mpin)\b")
PIN_CUES = (*PIN_WORDS, r"(?:login|unlock|account)\s*pin")
OTP_WORDS = r"\b(otp|one[-\s]?time(?:\s*code)?|verification\s*code|2fa|two[-\s]?factor|ओटीपी|एकबारीय)\b"
OTP_CUES = r"\b(otp|one[-\s]?time(?:\s*code)?|verification\s*code|2fa)\b"
HARD = ("otp", "cvv", "authentication_secret")
LABELS = {"otp": "one-time code (OTP)", "pin": "security PIN", "security_pin": "security PIN", "cvv": "security code (CVV)", "authentication_secret": "verification secret", "manual": "your input"}
NOT_DIGITS = ("hidden", "email", "search", "url", "checkbox", "radio", "submit", "button", "file")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(java(p, True))
    return F.coalesce(found, F.lit(False))


def pin_cue(text: Column) -> Column:
    """Whether a text speaks of a security PIN rather than of a one-time code."""
    other = text.rlike(java(OTP_CUES, True)) & ~text.rlike(java(PIN_WORDS[0], True))
    return _any(text, PIN_CUES) & ~F.coalesce(other, F.lit(False))


def digit_box(input_type: Column, max_length: Column, input_mode: Column, autocomplete: Column, in_cluster: Column) -> Column:
    """Whether a field looks like one of the boxes of a PIN. in_cluster: four to eight such boxes share an ancestor."""
    length = F.coalesce(max_length.try_cast("int"), F.lit(0))
    alone = length.isin(1, 6) | F.lower(input_mode).isin("numeric", "tel") | (autocomplete == "one-time-code") | input_type.isin("tel", "number")
    return ~input_type.isin(*NOT_DIGITS) & (F.coalesce(alone, F.lit(False)) | (input_type.isin("password", "text") & in_cluster))


def digit_clusters(nodes: DataFrame, page: str = "page_id", hops: int = 6) -> DataFrame:
    """(page, node_id): inputs that share an ancestor, at most `hops` up, with four to eight boxes for digits."""
    kind = F.lower(F.coalesce(F.col("attrs")["type"], F.lit("text")))
    mode, length = F.lower(F.coalesce(F.col("attrs")["inputmode"], F.lit(""))), F.coalesce(F.col("attrs")["maxlength"].try_cast("int"), F.lit(0))
    box = kind.isin("password", "tel", "text", "number") & (length.isin(1, 6) | mode.isin("numeric", "tel") | kind.isin("password", "tel"))
    inputs = nodes.filter(F.col("tag") == "input")
    counted = inputs.filter(box).select(page, F.explode("ancestors").alias("up")).groupBy(page, "up").count().filter(F.col("count").between(4, 8))
    return inputs.select(page, "node_id", F.explode(F.slice("ancestors", 1, hops)).alias("up")).join(counted, [page, "up"], "left_semi").select(page, "node_id").distinct()


def gate_kind(page_text: Column) -> Column:
    """The kind of gate that an element row is: cvv, authentication_secret, pin, otp or null. page_text: all wording of its page."""
    kind, auto = F.lower(F.coalesce("input_type", F.lit(""))), F.lower(F.coalesce("autocomplete", F.lit("")))
    has = lambda c: F.coalesce(F.array_contains("categories", c), F.lit(False))
    field = F.lower("tag").isin("input", "textarea") | (F.lower("kind") == "input")
    words = haystack(F.col("text"), F.col("placeholder"), F.col("name"), F.col("html_id"), F.col("aria_label"))
    says_otp = words.rlike(java(OTP_WORDS, True))
    on_pin_page = _any(page_text, PIN_WORDS) & ((auto == "one-time-code") | kind.isin("password", "tel", "number") | has("password"))
    secret = (kind == "password") | has("password") | auto.isin("current-password", "new-password")
    short = words.rlike(java(r"\b(pin|mpin|m[\s-]?pin|passcode)\b", True)) | page_text.rlike(java(PIN_WORDS[0], True))
    return F.when(
        F.coalesce(field, F.lit(False)),
        F.when((kind == "cc-csc") | (auto == "cc-csc") | has("cvv"), "cvv")
        .when(has("authentication_secret"), "authentication_secret")
        .when(~says_otp & (has("security_pin") | _any(words, PIN_WORDS) | on_pin_page), "pin")
        .when((kind == "otp") | (auto == "one-time-code") | has("otp") | says_otp, "otp")
        .when(secret & short, "pin"),
    )


def gates(elements: DataFrame, profile_has_pin: DataFrame | None = None) -> DataFrame:
    """(page_id, present, blocking, kind, empty_count, filled_count) of each page; the first empty hard kind counts, then the first empty PIN.

    profile_has_pin: (page_id) of pages whose profile can fill a PIN.
    """
    words = haystack(F.col("text"), F.col("placeholder"), F.col("name"), F.col("html_id"), F.col("aria_label"))
    pages = elements.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", words.alias("w")))), lambda x: x["w"]), " ").alias("_page"))
    rows = elements.join(pages, "page_id").withColumn("gate", gate_kind(F.col("_page")))
    empty, hard = ~F.coalesce("has_value", F.lit(False)) & F.col("gate").isNotNull(), F.col("gate").isin(*HARD)
    filled = F.coalesce("has_value", F.lit(False)) & F.col("gate").isNotNull()
    first = lambda test: F.min_by(F.when(test, F.col("gate")), F.when(test, F.col("pos")))
    out = rows.groupBy("page_id").agg(
        F.count_if(empty & hard).alias("_hard"), F.count_if(empty & ~hard).alias("_pin"), F.count_if(filled).alias("filled_count"),
        first(empty & hard).alias("_h"), first(empty & ~hard).alias("_p"), first(filled).alias("_f"),
    )
    able = F.lit(False)
    if profile_has_pin is not None:
        out = out.join(profile_has_pin.select("page_id", F.lit(True).alias("_able")).distinct(), "page_id", "left")
        able = F.coalesce("_able", F.lit(False))
    return out.select(
        "page_id",
        ((F.col("_hard") + F.col("_pin") + F.col("filled_count")) > 0).alias("present"),
        ((F.col("_hard") > 0) | ((F.col("_pin") > 0) & ~able)).alias("blocking"),
        F.coalesce("_h", "_p", "_f").alias("kind"),
        F.when(F.col("_hard") > 0, F.col("_hard")).otherwise(F.col("_pin")).alias("empty_count"),
        "filled_count",
    )


def gate_label(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(names[kind], names["manual"])


def gate_key(identity: Column, kind: Column, empty_count: Column) -> Column:
    return F.concat_ws("|", identity, kind, empty_count.cast("string"))


def accepts_category(category: Column) -> Column:
    """Whether an element row may take a saved value of a category: by its categories, input type, hints or wording."""
    kind, auto = F.lower(F.coalesce("input_type", F.lit(""))), F.lower(F.coalesce("autocomplete", F.lit("")))
    words = haystack(F.col("text"), F.col("placeholder"), F.col("name"), F.col("html_id"), F.col("aria_label"))
    hints = {
        "email": (kind == "email") | (auto == "email"),
        "phone": (kind == "tel") | auto.isin("tel", "tel-national"),
        "person_name": auto.isin("name", "given-name"),
        "pin_code": (auto == "postal-code") | words.rlike(java(r"\b(?:pin(?:code)?|zip|postal[-_\s]?code)\b", True)),
        "address": auto.rlike("^(?:street-address|address-line[12]|address-level[12])$") | words.rlike(java(r"\b(?:street|postal|mailing|billing|shipping|delivery|city|locality|landmark|province|state)\b", True)),
        "country": auto.isin("country", "country-name"),
        "username": words.rlike(java(r"\buser\s*id\b", True)),
        "fax": words.rlike(java(r"\bfax\b", True)),
        "security_pin": (_any(words, PIN_CUES) | ((kind == "password") & words.rlike(java(r"\bpin\b", True)))) & ~F.coalesce(F.arrays_overlap("categories", F.array(F.lit("otp"), F.lit("cvv"))), F.lit(False)),
    }
    found = F.coalesce(F.array_contains(F.col("categories"), category), F.lit(False))
    for name, test in hints.items():
        found = found | ((category == name) & F.coalesce(test, F.lit(False)))
    return found
