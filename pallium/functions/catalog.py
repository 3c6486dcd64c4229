"""The category dimension: what counts as personal data, how fields announce it, and the policy that gates it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.functions.text import java

LEVELS = ("unknown", "potentially_sensitive", "sensitive")


@dataclass(frozen=True)
class Category:
    id: str
    group: str
    level: str = "potentially_sensitive"
    field_only: bool = True
    source: str = "dom"
    input_types: tuple[str, ...] = ()
    autocomplete: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()  # ECMAScript, case ignored
    enabled: bool = True


def _row(id: str, group: str, patterns: list[str], strong: bool = False, **more) -> Category:
    return Category(id, group, "sensitive" if strong else "potentially_sensitive", patterns=tuple(patterns), **more)


#: Categories in order, their groups, hints and patterns.
CATEGORIES = (
    _row("password", "credentials", ["password", "passwd", "पासवर्ड", "कूटशब्द"], True, input_types=("password",), autocomplete=("current-password", "new-password")),
    _row("otp", "credentials", [r"\botp\b", r"one[-\s]?time", r"one[-\s]?time[-\s]?code", "ओटीपी", "एकबारीय"], True, autocomplete=("one-time-code",)),
    _row(
        "security_pin",
        "credentials",
        [r"security\s*pin", r"6[\s-]?digit\s+(?:security\s+)?pin", r"\b(?:m[\s-]?pin|mpin)\b", r"digilocker.{0,32}\bpin\b", r"(?:login|unlock|account)\s*pin"],
        True,
    ),
    _row(
        "authentication_secret",
        "credentials",
        [r"api[-_\s]?key", r"access[-_\s]?token", r"auth(?:orization)?[-_\s]?token", r"bearer[-_\s]?token", r"session[-_\s]?(?:id|token)"],
        True,
    ),
    _row(
        "username",
        "credentials",
        [r"(?<!\bcard\s)user\s*name", r"(?<!\bcard\s)username", r"\buser\s*id\b", r"(?:उपयोगकर्ता|प्रयोगकर्ता)\s*नाम"],
        autocomplete=("username",),
    ),
    _row(
        "payment_card",
        "payments",
        [r"card\s*(number|no\.?|num)", r"credit\s*card", r"debit\s*card", r"कार्ड\s*(?:संख्या|नंबर|नम्बर)", r"(?:क्रेडिट|डेबिट)\s*कार्ड"],
        True,
        autocomplete=("cc-number", "cc-exp", "cc-exp-month", "cc-exp-year"),
    ),
    _row("card_type", "payments", [r"(?:credit\s*)?card\s*type", r"\bcc[-_]?type\b"], autocomplete=("cc-type",)),
    _row("cvv", "payments", [r"\bcvv\b|\bcvc\b|\bcvv2\b", r"security\s*code", "सीवीवी"], True, autocomplete=("cc-csc",)),
    _row("card_holder_name", "payments", [r"card\s*(?:user|holder)\s*name", r"name\s*on\s*(?:the\s*)?card", "cardholder"], autocomplete=("cc-name",)),
    _row("card_issuing_bank", "payments", [r"card\s*issuing\s*bank", r"issuing\s*bank"]),
    _row("card_service_phone", "payments", [r"customer\s*service\s*phone", r"card\s*customer\s*service"]),
    _row("bank_account", "payments", ["ifsc", "iban", "swift", r"account\s*(number|no\.?)", r"खाता\s*(?:संख्या|नंबर|नम्बर)", r"बैंक\s*खाता", "आईएफएससी"], True),
    _row("upi", "payments", [r"\bupi\b", "यूपीआई"], field_only=False),
    _row("email", "contact", ["e-?mail", "ई-?मेल"], field_only=False, input_types=("email",), autocomplete=("email",)),
    _row(
        "phone",
        "contact",
        [r"(?<!\b(?:customer\s*service|service)\s+)phone", "mobile", r"\btel\b", "whatsapp", "मोबाइल", "फ़?ोन", "दूरभाष"],
        field_only=False,
        input_types=("tel",),
        autocomplete=("tel", "tel-national", "tel-local"),
    ),
    _row("fax", "contact", [r"\bfax\b", r"[_-]fax\b"]),
    _row("website", "contact", [r"web\s*site", r"\bwebsite\b", r"\bhomepage\b"], input_types=("url",), autocomplete=("url",)),
    _row(
        "address",
        "contact",
        [
            r"\b(?:street|postal|mailing|billing|shipping|delivery|residential|permanent|correspondence|registered|home|office)\s+address\b",
            r"\baddress\s*(?:line)?\s*[12]\b",
            r"address(?:[-_]?line)?[-_]?[12]\b",
            r"(?<!\b(?:e-?mail|ip|mac|web|url|wallet|crypto)\s{0,2})\baddress\b(?!\s+(?:your|the|this|my|our|its|their|a|any|all|it|them|these|those)\b)",
            r"\blocality\b",
            r"\blandmark\b",
            r"(?:डाक|पूरा|स्थायी|वर्तमान|निवास|पत्राचार)\s*पता",
            r"पता(?!\s*(?:है|हैं|नहीं|नही|चला|चल|लगा|लगाना|करें|कर|करना))",
        ],
        field_only=False,
        autocomplete=("street-address", "address-line1", "address-line2", "address-level1", "address-level2"),
    ),
    _row(
        "pin_code",
        "contact",
        [r"\bpincode\b", r"\bpin\s*code\b", r"\bpostal\s*code\b", r"\bzip\s*code\b", r"\bzip\b(?!\s*(?:file|archive|folder|download|drive))", r"पिन\s*कोड"],
        field_only=False,
        autocomplete=("postal-code",),
    ),
    _row("country", "contact", [r"\bcountry\b"], autocomplete=("country", "country-name")),
    _row(
        "person_name",
        "identity",
        [r"first\s*name", r"last\s*name", r"full\s*name", "surname", r"given\s*name", r"(?:पूरा|पहला|अंतिम|प्रथम)\s*नाम", "उपनाम"],
        field_only=False,
        autocomplete=("name", "given-name", "family-name"),
    ),
    _row(
        "person_title",
        "identity",
        [r"(?<![A-Za-z])(?<!(?:job|page|document|post|working)\s)title\b", r"\b(?:honorific|salutation)\b"],
        autocomplete=("honorific-prefix",),
    ),
    _row("middle_initial", "identity", [r"middle\s*initial", r"middle[-_\s]?name", r"middle_i\b"], autocomplete=("additional-name",)),
    _row(
        "company",
        "identity",
        [r"(?<![A-Za-z])company(?:\s*name)?\b(?!\.(?:co|com|org|net|io|in)\b)", r"\b(?:employer|organi[sz]ation)\b"],
        autocomplete=("organization",),
    ),
    _row("position", "identity", [r"(?<![A-Za-z])position\b", r"\bjob\s*title\b", r"\b(?:designation|occupation)\b"], autocomplete=("organization-title",)),
    _row(
        "date_of_birth",
        "identity",
        [r"date\s*of\s*birth", r"\bdob\b", "birthday", r"जन्म\s*(?:तिथि|दिनांक)", r"जन्म\s*की\s*तारीख"],
        field_only=False,
        autocomplete=("bday", "bday-day", "bday-month", "bday-year"),
    ),
    _row("sex", "identity", [r"\b(?:sex|gender)\b"]),
    _row("age", "identity", [r"\bage\b"]),
    _row("birth_place", "identity", [r"birth\s*place", r"place\s*of\s*birth", r"जन्म\s*स्थान"]),
    _row("income", "identity", [r"\bincome\b", r"\bsalary\b"]),
    _row("aadhaar", "gov_id", ["aadhaar", "aadhar", "uidai", "आधार"], True),
    _row("pan", "gov_id", [r"\bpan\b", r"permanent\s*account", "पैन"], True),
    _row("passport", "gov_id", ["passport", "पासपोर्ट"], True),
    _row("voter_id", "gov_id", ["voter", r"ration\s*card", "मतदाता", r"राशन\s*कार्ड"], field_only=False),
    _row("gstin", "gov_id", ["gstin", r"\bgst\b", "जीएसटी"]),
    _row("ssn", "gov_id", [r"\bssn\b", r"social\s*security"], True),
    _row("driver_license", "gov_id", [r"driver'?s?\s*licen[cs]e"], True),
    _row("custom_message", "form_extras", [r"custom\s*message"]),
    _row("comments", "form_extras", [r"\bcomments?\b"]),
    _row("faces_people", "visual", [], field_only=False, source="vision"),
    _row("image_embedded_text", "visual", [], field_only=False, source="ocr"),
    _row("canvas_text", "visual", [], field_only=False, source="ocr"),
)
BY_ID = {c.id: c for c in CATEGORIES}
#: Categories whose values are never recoverable.
ONE_WAY = ("password", "cvv", "otp", "authentication_secret", "truncated_text")
#: Tokens of placeholders that are not the category's name.
TOKENS = {"payment_card": "CARD", "bank_account": "BANK", "person_name": "NAME", "image_embedded_text": "IMAGE_TEXT", "truncated_text": "TRUNCATED"}
#: Categories that a saved profile must not hold, as they are secrets of one moment.
PROFILE_REFUSED = ("otp", "cvv", "authentication_secret", "password", "faces_people", "image_embedded_text", "canvas_text")
PROFILE_LIMIT = 500


#: For each category, lower-case words of which a text that fits one of its patterns holds at least one.
NEEDS = {
    "password": ("pass", "पासवर्ड", "कूटशब्द"), "otp": ("otp", "one", "ओटीपी", "एकबारीय"), "security_pin": ("pin",), "authentication_secret": ("key", "token", "session"),
    "username": ("user", "नाम"), "payment_card": ("card", "कार्ड"), "card_type": ("type",), "cvv": ("cvv", "cvc", "security", "सीवीवी"), "card_holder_name": ("card",),
    "card_issuing_bank": ("issuing",), "card_service_phone": ("service",), "bank_account": ("ifsc", "iban", "swift", "account", "खाता", "आईएफएससी"), "upi": ("upi", "यूपीआई"),
    "email": ("mail", "मेल"), "phone": ("phone", "mobile", "tel", "whatsapp", "मोबाइल", "ोन", "दूरभाष"), "fax": ("fax",), "website": ("web", "homepage"),
    "address": ("address", "locality", "landmark", "पता"), "pin_code": ("pin", "postal", "zip", "पिन"), "country": ("country",), "person_name": ("name", "नाम"),
    "person_title": ("title", "honorific", "salutation"), "middle_initial": ("middle",), "company": ("company", "employer", "organi"),
    "position": ("position", "job", "designation", "occupation"), "date_of_birth": ("birth", "dob", "जन्म"), "sex": ("sex", "gender"), "age": ("age",),
    "birth_place": ("birth", "जन्म"), "income": ("income", "salary"), "aadhaar": ("aadha", "uidai", "आधार"), "pan": ("pan", "permanent", "पैन"),
    "passport": ("passport", "पासपोर्ट"), "voter_id": ("voter", "ration", "मतदाता", "राशन"), "gstin": ("gst", "जीएसटी"), "ssn": ("ssn", "social"),
    "driver_license": ("driver",), "custom_message": ("custom",), "comments": ("comment",),
}


def normalise_policy(policy: dict[str, bool] | None = None) -> dict[str, bool]:
    """Every category on or off: the given choice, else its default; unknown names go."""
    given = policy or {}
    return {c.id: bool(given[c.id]) if c.id in given else c.enabled for c in CATEGORIES}


def table(spark: SparkSession, policy: dict[str, bool] | None = None) -> DataFrame:
    """The dimension as rows (ordinal, id, group, level, rank, source, field_only, enabled, n_patterns)."""
    on = normalise_policy(policy)
    rows = [(k, c.id, c.group, c.level, LEVELS.index(c.level), c.source, c.field_only, on[c.id], len(c.patterns)) for k, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "ordinal int, id string, group string, level string, rank int, source string, field_only boolean, enabled boolean, n_patterns int")


def grouped(spark: SparkSession) -> DataFrame:
    """(group, items): categories of each group in catalog order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"])
    return table(spark).groupBy("group").agg(items.alias("items"))


def mentions(category: str, text: Column, low: Column | None = None) -> Column:
    """Whether a text mentions a category by one of its patterns. low: the text in lower case, if there is a column of it.

    The patterns are only tried on texts that hold one of the category's words.
    """
    low = F.lower(text) if low is None else low
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    held = any_of(F.contains(low, F.lit(word)) for word in NEEDS.get(category, ("",)))
    return F.coalesce(held & any_of(text.rlike(java(pattern, True)) for pattern in BY_ID[category].patterns), F.lit(False))


def matching(is_field: Column, input_type: Column, autocomplete: Column, hay: Column, policy: dict[str, bool] | None = None, low: Column | None = None) -> Column:
    """The categories that an element's purpose announces, in catalog order. low: hay in lower case, if there is a column of it."""
    on = normalise_policy(policy)
    tests = []
    for c in CATEGORIES:
        if c.source != "dom" or not on[c.id]:
            continue
        test = mentions(c.id, hay, low)
        if c.input_types:
            test = test | F.coalesce(F.lower(input_type).isin(*c.input_types), F.lit(False))
        if c.autocomplete:
            hints = F.split(F.lower(F.coalesce(autocomplete, F.lit(""))), r"\s+")
            # few elements have a hint, and cutting one up is dear
            test = test | F.coalesce((autocomplete != "") & F.arrays_overlap(hints, F.array(*map(F.lit, c.autocomplete))), F.lit(False))
        if c.field_only:
            test = is_field & test
        tests.append(F.when(test, F.lit(c.id)))
    return F.array_compact(F.array(*tests))


def level_rank(category: Column) -> Column:
    levels = F.create_map(*(F.lit(x) for c in CATEGORIES for x in (c.id, LEVELS.index(c.level))))
    return F.coalesce(levels[category], F.lit(0))


def level(categories: Column) -> Column:
    """The strongest level of an array of categories."""
    rank = F.coalesce(F.array_max(F.transform(categories, level_rank)), F.lit(0))
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)


def token(category: Column) -> Column:
    special = F.create_map(*(F.lit(x) for pair in TOKENS.items() for x in pair))
    return F.coalesce(special[category], F.regexp_replace(F.upper(category), "[^A-Z0-9]+", "_"))


def one_way(category: Column) -> Column:
    return category.isin(*ONE_WAY)


def profile_placeholder(category: Column) -> Column:
    return F.concat(F.lit("<PROFILE_"), F.regexp_replace(F.upper(category), "[^A-Z0-9]+", "_"), F.lit(">"))


def sanitised_profile(values: Column) -> Column:
    """A map of saved values without refused or unknown categories, trimmed, blank or overlong ones left out."""
    allowed = [c.id for c in CATEGORIES if c.id not in PROFILE_REFUSED]
    trimmed = F.transform_values(values, lambda k, v: F.trim(v))
    return F.map_filter(trimmed, lambda k, v: k.isin(*allowed) & (F.length(v) > 0) & (F.length(v) <= PROFILE_LIMIT))


def public_profile(values: Column) -> Column:
    """What a planner may see of a profile: placeholders, by category, without values."""
    return F.transform_values(sanitised_profile(values), lambda k, v: profile_placeholder(k))
