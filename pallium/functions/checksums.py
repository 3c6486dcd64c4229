"""Check digits and structural validators as columns over a normalised value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the permutation of the Verhoeff scheme; its rows are powers of it.
_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
#: Characters of the GSTIN check, holder types of a PAN.
_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PAN_HOLDERS = "ABCFGHJLPTK"


def _dihedral(a: int, b: int) -> int:
    """The product in the group D5 with rotations 0-4 and reflections 5-9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permutations() -> list[int]:
    rows, row = [], list(range(10))
    for _ in range(8):
        rows += row
        row = [_STEP[x] for x in row]
    return rows


def _literal(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def _digit(text: Column, position: Column) -> Column:
    return F.ascii(F.substring(text, position, F.lit(1))) - 48


def verhoeff(digits: Column) -> Column:
    product, permuted = _literal([_dihedral(a, b) for a in range(10) for b in range(10)]), _literal(_permutations())
    n = F.length(digits)
    fold = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0),
        lambda c, i: F.element_at(product, c * 10 + F.element_at(permuted, (i % 8) * 10 + _digit(digits, n - i) + 1) + 1),
    )
    return F.when(digits.rlike("^[0-9]+$"), fold == 0).otherwise(F.lit(False))


def luhn(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def gstin_check(value: Column) -> Column:
    code = lambda p: F.instr(F.lit(_BASE36), F.substring(value, p, F.lit(1))) - 1
    # weights 1, 2, 1, 2 ... from the first character, so that the fourteenth has 2
    term = lambda p: code(p) * F.when(p % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda s, p: s + F.floor(term(p) / 36).cast("int") + term(p) % 36)
    known = F.upper(value).rlike("^[0-9A-Z]{15}$") & (F.upper(value) == value)
    return F.when(known, code(F.lit(15)) == (36 - total % 36) % 36).otherwise(F.lit(False))


def pan(value: Column) -> Column:
    return value.rlike(f"^[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]$")


def ifsc(value: Column) -> Column:
    return value.rlike("^[A-Z]{4}0[A-Z0-9]{6}$")


def aadhaar(digits: Column) -> Column:
    return digits.rlike("^[2-9][0-9]{11}$") & verhoeff(digits)


def card(digits: Column) -> Column:
    return digits.rlike("^[0-9]{13,19}$") & luhn(digits)


def gstin(value: Column) -> Column:
    state = F.substring(value, 1, 2).try_cast("int")
    shape = value.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$")
    return shape & state.between(1, 38) & pan(F.substring(value, 3, 10)) & gstin_check(value)
