"""The identifier matchers: a pattern, how a match is normalised, and what makes it valid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pallium.functions import checksums
from pallium.functions.text import digits_only, java, upper_compact

#: How much a kind of evidence counts.
CONFIDENCE_RANK = {"checksum": 3, "structure": 2, "shape": 1, "keyword": 0}


@dataclass(frozen=True)
class Matcher:
    category: str
    confidence: str
    pattern: str  # ECMAScript
    normalise: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    ignore_case: bool = False
    needs: str = ""  # a cheap pattern that a text with a match must hold

    @property
    def java(self) -> str:
        return java(self.pattern, self.ignore_case)


def _same(value: Column) -> Column:
    return value


def _any(value: Column) -> Column:
    return F.lit(True)


def _upto(n: int) -> Callable[[Column], Column]:
    return lambda value: F.length(value) <= n


def _phone(digits: Column) -> Column:
    local = F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)
    return local.rlike("^[6-9][0-9]{9}$")


#: Categories, kinds of evidence and patterns, in the order that settles ties.
MATCHERS = (
    Matcher("password", "structure", r"\b(?:password|passwd|passcode)\s*(?:is|[:=])\s*\S+", _same, _upto(1024), True, needs="(?i)pass(?:w|code)"),
    Matcher("otp", "structure", r"\b(?:otp|one[-\s]?time\s*code|verification\s*code)\s*(?:is|[:=])\s*\d{4,8}\b", _same, _any, True, needs="[0-9]{4}"),
    Matcher("cvv", "structure", r"\b(?:cvv2?|cvc|security\s*code)\s*(?:is|[:=])\s*\d{3,4}\b", _same, _any, True, needs="[0-9]{3}"),
    Matcher("aadhaar", "checksum", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", digits_only, checksums.aadhaar, needs="[0-9]{4}"),
    Matcher("payment_card", "checksum", r"\b\d(?:[\s-]?\d){12,18}\b", digits_only, checksums.card, needs="[0-9]"),
    Matcher("gstin", "checksum", r"\b\d{2}[A-Za-z]{5}\d{4}[A-Za-z][A-Za-z\d][Zz][A-Za-z\d]\b", upper_compact, checksums.gstin, needs="[0-9]{4}"),
    Matcher("pan", "structure", r"\b[A-Za-z]{5}\d{4}[A-Za-z]\b", upper_compact, checksums.pan, needs="[0-9]{4}[A-Za-z]"),
    Matcher("bank_account", "structure", r"\b[A-Za-z]{4}0[A-Za-z\d]{6}\b", upper_compact, checksums.ifsc, needs="[A-Za-z]0[A-Za-z0-9]"),
    Matcher("authentication_secret", "structure", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", _same, _upto(4096), needs="eyJ"),
    Matcher(
        "authentication_secret",
        "structure",
        r"\b(?:Bearer\s+|access[_-]?token[=:]|session(?:id|token)[=:]|api[_-]?key[=:])[A-Za-z0-9._~+/-]{8,}",
        _same,
        _upto(4096),
        True,
        needs="(?i)bearer|token|session|api",
    ),
    Matcher("email", "structure", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _same, _upto(254), needs="@"),
    Matcher("upi", "structure", r"[A-Za-z0-9.\-_]{2,64}@[A-Za-z]{2,64}(?![A-Za-z])(?!\.[A-Za-z])", _same, lambda v: v.rlike(r"^[A-Za-z0-9.\-_]{2,64}@[A-Za-z]{2,64}$"), needs="@"),
    Matcher("phone", "structure", r"(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)", digits_only, _phone, needs="[0-9]{5}"),
    Matcher("voter_id", "shape", r"\b[A-Za-z]{3}\d{7}\b", upper_compact, lambda v: v.rlike("^[A-Z]{3}[0-9]{7}$"), needs="[A-Za-z][0-9]{7}"),
    Matcher("passport", "shape", r"\b[A-Za-z]\d{7}\b", upper_compact, lambda v: v.rlike("^[A-PR-WY][0-9]{7}$"), needs="[A-Za-z][0-9]{7}"),
)
SHAPE_CATEGORIES = tuple(m.category for m in MATCHERS if m.confidence == "shape")
