"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A study is due one year after its end plus 28 days of grace.
DUE_MONTHS = 12
GRACE_DAYS = 28

# Fixed value: day 0 of the statistics package's day numbers.
DAY_ZERO = "1960-01-01"


def due_date_cutoff(last_scrape: Column) -> Column:
    """Studies that ended before this day are due at ``last_scrape``."""
    return F.date_sub(F.add_months(last_scrape, -DUE_MONTHS), GRACE_DAYS)


def from_day_number(days: Column | int) -> Column:
    """Date of a day number counted from 1960-01-01."""
    days = F.lit(days) if isinstance(days, int) else days
    return F.date_add(F.lit(DAY_ZERO).cast("date"), days)


def to_day_number(day: Column) -> Column:
    return F.date_diff(day, F.lit(DAY_ZERO).cast("date"))


def parse_date(text: Column, formats: tuple[str, ...] = ("yyyy-M-d",)) -> Column:
    """First format that parses wins; a text no format fits stops the job."""
    tries = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats]
    message = F.concat(F.lit("date in no known format: "), text)
    return F.coalesce(*tries, F.when(text.isNotNull(), F.raise_error(message).cast("date")))
