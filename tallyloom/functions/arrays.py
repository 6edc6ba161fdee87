"""Numbers, arrays and JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalised(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def settled(c: Column, digits: int) -> Column:
    """Rounded after a nudge of a thousandth of the last digit, so that decimal ties, and sums that differ in their last
    bits, come out alike in every engine."""
    return F.round(c + F.lit(10.0 ** -(digits + 3)), digits)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den; infinite where the denominator is 0, null where either is missing."""
    return F.when(den == 0, F.lit(float("inf"))).otherwise(num / den)


def bonferroni(p: Column, m: int) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p * m)) if m > 0 else p


def json_numbers(c: Column) -> Column:
    """The numbers of a JSON array; null where the text is no array."""
    return F.from_json(c, "array<double>")


def json_count(c: Column, path: str) -> Column:
    """A whole number under a path, null where it is none."""
    text = F.get_json_object(c, path)
    return F.when(text.rlike("^[0-9]+$"), text.cast("bigint"))


def utilisation_watts(share: Column, idle: float, load: float, exponent: float = 1.0, floor: float = 0.0, ceiling: float | None = None) -> Column:
    watts = F.lit(idle) + F.pow(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(exponent)) * (load - idle)
    low = F.greatest(watts, F.lit(floor))
    return F.least(low, F.lit(ceiling)) if ceiling is not None else low


# Units of power in watts.
UNIT_WATTS = {"kw": 1e3, "w": 1.0, "mw": 1e-3, "uw": 1e-6}


def parse_watts(c: Column, unit: str = "w") -> Column:
    """All numbers of a sampler's text, summed and scaled to watts; null where there is none."""
    found = F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x.cast("double")) * UNIT_WATTS[unit.lower()])


def usable_budget(requested: Column, window: Column, prefix: Column, reserve: int) -> Column:
    return F.least(requested, window - prefix - reserve)
