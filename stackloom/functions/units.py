"""Units of measure: scaling, labels, percentages, and how a profile type is counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit, other spellings, size in the family's base unit; the unit that stands for unknown targets comes first.
FAMILIES = [
    ("B", [("B", ("b", "byte"), 1.0), ("kB", ("kb", "kbyte", "kilobyte"), 2.0**10), ("MB", ("mb", "mbyte", "megabyte"), 2.0**20), ("GB", ("gb", "gbyte", "gigabyte"), 2.0**30), ("TB", ("tb", "tbyte", "terabyte"), 2.0**40), ("PB", ("pb", "pbyte", "petabyte"), 2.0**50)]),
    ("s", [("ns", ("ns", "nanosecond"), 1.0), ("us", ("μs", "us", "microsecond"), 1e3), ("ms", ("ms", "millisecond"), 1e6), ("s", ("s", "sec", "second"), 1e9), ("hrs", ("hour", "hr"), 3.6e12)]),
]
PLAIN = ("count", "sample", "unit", "minimum", "auto")


def _known(unit: str) -> tuple[str, list, float] | None:
    """(the family's default, its units, the factor) of a spelling; a plural s is ignored."""
    unit = unit.lower()
    unit = unit.removesuffix("s") if len(unit) > 2 else unit
    return next(((default, units, factor) for default, units in FAMILIES for _, names, factor in units if unit in names), None)


def scale(value: Column, source: str, target: str = "auto") -> Column:
    """``(value, unit)`` as a struct; ``auto`` takes the largest unit of which there is one at least."""
    pair = lambda v, u: F.struct(v.cast("double").alias("value"), F.lit(u).alias("unit"))
    found = _known(source)
    if not found:
        return pair(value, "" if target in PLAIN else target)
    default, units, factor = found
    base = F.abs(value) * F.lit(factor)
    sign = F.when(value < 0, -1.0).otherwise(1.0)
    of = {name: size for name, _, size in units}
    if target not in ("auto", "minimum"):
        wanted = _known(target)
        name = next(n for n, _, size in units if size == wanted[2]) if wanted and wanted[0] == default else default
        return pair(sign * base / F.lit(of[name]), name)
    fallback = pair(sign * base / F.lit(of[default]), default)
    return reduce(lambda out, u: F.when(base / F.lit(u[2]) >= 1, pair(sign * base / F.lit(u[2]), u[0])).otherwise(out), units, fallback)


def label(value: Column, source: str, target: str = "auto") -> Column:
    """Two decimals, halves to even, and the unit; whole numbers without decimals, zero without a unit."""
    scaled = scale(value, source, target)
    digits = F.regexp_replace(F.format_string("%.2f", F.bround(scaled["value"], 2)), r"\.00$", "")
    return F.when(digits.isin("0", "-0"), "0").otherwise(F.concat(digits, scaled["unit"]))


def percentage(value: Column, total: Column) -> Column:
    """Percent of the total, two decimals; under one percent two significant digits would be rounded, so four decimals are kept."""
    ratio = F.when(total == 0, 0.0).otherwise(F.abs(value / total) * 100)
    return F.when((ratio >= 99.95) & (ratio <= 100.05), "100%").when(ratio >= 1, F.format_string("%.2f%%", ratio)).otherwise(F.format_string("%.4f%%", ratio))


def mapping_name(path: Column) -> Column:
    """The file name of a mapping's path."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def counted_as(sample_unit: str) -> tuple[str, int]:
    """(units, sample rate) of a profile's values: nanoseconds are samples at 1e9 a second, bytes and objects count as they are."""
    if sample_unit == "nanoseconds":
        return "samples", 1_000_000_000
    return {"bytes": ("bytes", 100), "count": ("objects", 100)}.get(sample_unit, ("samples", 100))
