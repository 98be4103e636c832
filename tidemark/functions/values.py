"""Money, units, ratios, hashes and tolerant parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minor units of a hundredth, with their major unit.
MINOR_UNITS = {"GBX": "GBP", "ZAC": "ZAR", "ILA": "ILS"}
PENCE_NAMES = ("gbx", "gbp.", "p", "pence", "penny", "gbpence")


def shift_months(day: Column, months: int) -> Column:
    """A day some months on, held at the month's end."""
    return F.add_months(day, months)


def unit_factor(unit: Column, to: Column) -> Column:
    """What an amount is multiplied by to go from a unit to another of the same currency; null for unrelated units."""
    major = lambda u: F.coalesce(*[F.when(u == a, F.lit(b)) for a, b in MINOR_UNITS.items()], u)
    power = lambda u: F.when(u.isin(*MINOR_UNITS), -2).otherwise(0)
    return F.when(major(unit) == major(to), F.pow(F.lit(10.0), power(unit) - power(to)))


def converted(amount: Column, unit: Column, to: Column, rate: Column) -> Column:
    """An amount through major units at a rate of `to`'s major unit for one of the unit's."""
    scale = lambda u: F.when(u.isin(*MINOR_UNITS), 100.0).otherwise(1.0)
    return amount / scale(unit) * rate * scale(to)


def half_even(x: Column, places: int = 6) -> Column:
    return F.bround(x, places)


def quantised(x: Column, places: int = 18) -> Column:
    """A decimal of 38 digits; digits beyond are rounded half up, as casts do."""
    return x.cast(f"decimal(38,{places})")


def unit_label(text: Column) -> Column:
    """A provider's unit as a code: pence in all spellings are GBX; GBp is pence, GBP pounds."""
    clean = F.trim(text)
    return F.when(clean == "GBp", "GBX").when(F.lower(clean).isin(*PENCE_NAMES), "GBX").otherwise(F.upper(clean))


def split_ratio(text: Column) -> tuple[Column, Column]:
    """(new, old) of 'a:b', 'a/b', 'a-for-b' or 'a for b' in lowest terms; nulls if it is none of these."""
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*(\d{1,9})(?:\.0+)?\s*(?::|/|-for-|\s+for\s+)\s*(\d{1,9})(?:\.0+)?\s*$", k), F.lit("")), F.lit("999999999")).cast("bigint")
    new, old = part(1), part(2)
    common = greatest_divisor(new, old)
    sound = (new > 0) & (old > 0)
    return F.when(sound, (new / common).cast("bigint")), F.when(sound, (old / common).cast("bigint"))


def greatest_divisor(a: Column, b: Column) -> Column:
    """Euclid's algorithm in as many steps as two 9-digit numbers can need."""
    start = F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    step = lambda s, _: F.when(s["y"] > 0, F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0))).alias("y"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(45)), start, step, lambda s: F.nullif(s["x"], F.lit(0)))


def parameter_hash(parameters: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a map's JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(parameters))
    return F.substring(F.sha2(F.to_json(F.map_from_entries(entries)), 256), 1, 16)


def tolerant_date(text: Column) -> Column:
    """A date from the usual spellings; null if it is none."""
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyyMMdd")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in forms])


def plausible_time(stamp: Column, period_end: Column, now: Column) -> Column:
    """After its period's end, not in the future, and not before 1980."""
    return (stamp > period_end) & (stamp <= now) & (F.year(stamp) >= 1980)


def period_class(text: Column) -> Column:
    """annual, interim or quarterly for a provider's names of periods."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("annual", "yearly", "fy", "12m", "a"), "annual").when(t.isin("interim", "half", "h1", "h2", "6m", "semi-annual", "s"), "interim").when(t.isin("quarterly", "q", "q1", "q2", "q3", "q4", "3m"), "quarterly")


def name_glob(name: Column, pattern: str) -> Column:
    """Whether a name fits a pattern of * and ?."""
    import re

    return name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")
