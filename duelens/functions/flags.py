"""0/1 flags and small codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three texts of the rare-disease field.
RARE_YES = "Yes"
RARE_NO = "No"
RARE_BLANK = "Information not present in EudraCT"

# Fixed value: marks a record from a country outside the register's area.
OUTSIDE_AREA_MARK = "-3rd"


def exact_or_pattern_flag(text: Column, exact: str, pattern: str) -> Column:
    """0, 1 for the exact text, 2 if the pattern is found (the pattern wins)."""
    return F.coalesce(F.when(text.rlike(pattern), 2).when(text == exact, 1), F.lit(0))


def recode_count(count: Column) -> Column:
    """1 and 2 stay, 3 to 99 become 3, anything else is left as it is."""
    return F.when(count.between(3, 99), F.lit(3)).otherwise(count)


def missing_to(code: Column, value: int) -> Column:
    return F.coalesce(code, F.lit(value))


def parse_boolean(text: Column, true_text: str = "Yes") -> Column:
    """True if the text equals ``true_text`` in any case; missing stays missing."""
    return F.lower(text) == true_text.lower()
