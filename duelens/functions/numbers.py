"""Rounding and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 1) -> Column:
    """Round half to even, on the decimal text of the number."""
    return F.bround(value, digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage to one decimal; null when there is nothing to divide by."""
    return half_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def percent_text(value: Column) -> Column:
    """'12.5%', or '-' when missing."""
    known = F.nanvl(value, F.lit(None).cast("double"))
    return F.coalesce(F.concat(known.cast("string"), F.lit("%")), F.lit("-"))


def default_if_invalid(value: Column, default: str) -> Column:
    """Text of a value, or ``default`` when it is null or NaN."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == "NaN"), F.lit(default)).otherwise(text)
