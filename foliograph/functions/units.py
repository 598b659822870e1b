"""Lengths, percentages and colours of the document model, as Column expressions.

A length is a 32-bit count of hundredths of a point, valid within a hundred
million either way; arithmetic on lengths saturates at 32 bits. A colour is
packed blue, green, red from the high byte down and shown as #RRGGBB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_POINT, PER_INCH, PER_MM = 100.0, 7200.0, 7200.0 / 25.4
LARGEST = 100_000_000
_LOW, _HIGH = -(1 << 31), (1 << 31) - 1


def _valid(x: Column) -> Column:
    """Rounded half away from zero, or null where the length is not valid."""
    whole = F.round(x)
    ok = ~F.isnan(x) & (F.abs(x) <= 1e15) & whole.between(-LARGEST, LARGEST)
    return F.when(ok, whole.cast("int"))


def from_points(x: Column) -> Column:
    return _valid(x * PER_POINT)


def from_inches(x: Column) -> Column:
    return _valid(x * PER_INCH)


def from_mm(x: Column) -> Column:
    return _valid(x * PER_MM)


def to_points(x: Column) -> Column:
    return x / F.lit(PER_POINT)


def to_mm(x: Column) -> Column:
    return x / F.lit(PER_MM)


def saturate(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(_LOW)), F.lit(_HIGH)).cast("int")


def add(a: Column, b: Column) -> Column:
    return saturate(a.cast("long") + b.cast("long"))


def subtract(a: Column, b: Column) -> Column:
    return saturate(a.cast("long") - b.cast("long"))


def divide(a: Column, b: Column) -> Column:
    """Toward zero; division by zero is zero."""
    quotient = F.try_divide(a.cast("double"), b.cast("double"))
    whole = F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient))
    return saturate(F.coalesce(whole, F.lit(0)))


def dimension(c: Column) -> Column:
    """``12pt``, ``3mm``, ``1in`` or a plain count, in any case; null for anything else."""
    text = F.lower(F.trim(c))
    number = F.regexp_extract(text, r"^([-+]?[0-9]*\.?[0-9]+)\s*(pt|mm|in)$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"(pt|mm|in)$", 1)
    whole = F.regexp_extract(text, r"^([-+]?[0-9]+)$", 1).try_cast("double")
    return F.when(unit == "pt", from_points(number)).when(unit == "mm", from_mm(number)).when(unit == "in", from_inches(number)).otherwise(_valid(whole))


def percentage(c: Column) -> Column:
    """A number before a percent sign, not negative; null for anything else."""
    number = F.regexp_extract(F.trim(c), r"^([-+]?[0-9]*\.?[0-9]+)%$", 1).try_cast("double")
    return F.when(number >= 0, number)


def colour(c: Column) -> Column:
    """Packed colour of #RRGGBB; null for anything else."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    packed = F.shiftleft(part(6), 16) + F.shiftleft(part(4), 8) + part(2)
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), packed)


def show_colour(x: Column) -> Column:
    byte = lambda n: F.lpad(F.hex(F.shiftright(x, n).bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(F.lit("#"), byte(0), byte(8), byte(16))


def ratio_ok(size: Column, compressed: Column, most: int = 100) -> Column:
    """Whether a stream's whole-number expansion stays within bounds."""
    return F.floor(size / F.greatest(compressed, F.lit(1))) <= most


def civil_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def printable(extent: Column, before: Column, after: Column) -> Column:
    """Page extent between its margins."""
    return subtract(subtract(extent, before), after)


def indent(base: Column, level: Column) -> Column:
    """Indent of a list level: the base again for each level, twenty points where there is none."""
    step = F.when(base > 0, base).otherwise(2000)
    return saturate(base.cast("long") + step.cast("long") * level)
