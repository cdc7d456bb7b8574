"""Reading the published tables: lookup, search, sort, page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page lengths offered, and the one used at first.
PAGE_LENGTHS = [10, 100, 500]
DEFAULT_PAGE_LENGTH = 100


def by_slug(rows: DataFrame, slug: str) -> DataFrame:
    return rows.where(F.col("slug") == slug)


def having_trials(sponsors: DataFrame) -> DataFrame:
    return sponsors.where(F.col("total_trials") > 0)


def sponsors_by_due(sponsors: DataFrame) -> DataFrame:
    """All sponsors, most due studies first."""
    return sponsors.orderBy(F.desc("total_due"), "slug")


def major_sponsors(sponsors: DataFrame) -> DataFrame:
    """Major sponsors, most studies first."""
    return sponsors.where(F.col("major") == 1).orderBy(
        F.desc("total_trials"), F.desc("total_due"), "slug"
    )


def search_words(query: str) -> list[str]:
    """Words of a query; text in double quotes stays together."""
    found = re.findall(r'"[^"]+"|[^ ]+', query)
    words = [w[1:-1] if len(w) > 1 and w[0] == w[-1] == '"' else w for w in found]
    return [w.replace('"', "", 1) for w in words]


def search_line(columns: list[str]) -> Column:
    """The columns of a row as one text in lower case."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.lower(F.translate(F.concat_ws("  ", *texts), "\n", " "))


def search_condition(query: str, columns: list[str]) -> Column:
    """Every word is found, in any order and case, in the columns taken together."""
    line = search_line(columns)
    condition = F.lit(True)
    for word in search_words(query):
        condition = condition & line.contains(word.lower())
    return condition


def search(rows: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    return rows.where(search_condition(query, columns or rows.columns))


def sort_keys(order: list[tuple[str, str]], tie: list[str]) -> list[Column]:
    """Sort columns with missing values lowest in either direction."""
    keys = [
        F.col(c).desc_nulls_last() if direction == "desc" else F.col(c).asc_nulls_first()
        for c, direction in order
    ]
    return [*keys, *(F.col(c).asc_nulls_first() for c in tie)]


def sort_rows(rows: DataFrame, order: list[tuple[str, str]], tie: list[str]) -> DataFrame:
    """Sort with missing values lowest in either direction."""
    return rows.orderBy(*sort_keys(order, tie))


def page(rows: DataFrame, number: int, length: int | None = DEFAULT_PAGE_LENGTH) -> DataFrame:
    """Page ``number`` (from 0) of sorted rows; a length of None means all rows."""
    if length is None:
        return rows
    return rows.offset(number * length).limit(length)
