"""Check digits of security identifiers, as expressions over higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def _letter_value(c: Column) -> Column:
    """0-9 for digits, 10-35 for A-Z."""
    return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)


def _sum(count: Column | int, worth) -> Column:  # noqa: ANN001
    last = F.lit(count) if isinstance(count, int) else count
    return F.aggregate(F.sequence(F.lit(1), last), F.lit(0), lambda a, i: a + worth(i))


def isin_is_valid(isin: Column) -> Column:
    """Two letters, nine characters and a digit, whose digits with letters as 10-35 pass the Luhn check."""
    spread = F.array_join(F.transform(F.split(isin, ""), lambda c: _letter_value(c).cast("string")), "")
    turned = F.reverse(spread)
    digit = lambda i: F.ascii(_at(turned, i)) - 48
    worth = lambda i: F.when(i % 2 == 0, F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)).otherwise(digit(i))
    return F.when(isin.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), _sum(F.length(spread), worth) % 10 == 0).otherwise(F.lit(False))


def sedol_is_valid(sedol: Column) -> Column:
    """Six digits or consonants and a digit; the sum with weights 1, 3, 1, 7, 3, 9, 1 divides by 10."""
    weights = F.array(*[F.lit(w) for w in (1, 3, 1, 7, 3, 9, 1)])
    total = _sum(7, lambda i: _letter_value(_at(sedol, i)) * F.element_at(weights, i))
    return F.when(sedol.rlike("^[0-9B-DF-HJ-NP-TV-Z]{6}[0-9]$"), total % 10 == 0).otherwise(F.lit(False))


def cusip_is_valid(cusip: Column) -> Column:
    """Eight of digits, letters, * @ # (36 to 38) and a check digit; every second value counts double, by its digits."""
    value = lambda c: F.when(c == "*", 36).when(c == "@", 37).when(c == "#", 38).otherwise(_letter_value(c))
    doubled = lambda i: value(_at(cusip, i)) * F.when(i % 2 == 0, 2).otherwise(1)
    total = _sum(8, lambda i: F.floor(doubled(i) / 10).cast("int") + doubled(i) % 10)
    return F.when(cusip.rlike("^[0-9A-Z*@#]{8}[0-9]$"), (10 - total % 10) % 10 == F.ascii(_at(cusip, F.lit(9))) - 48).otherwise(F.lit(False))
