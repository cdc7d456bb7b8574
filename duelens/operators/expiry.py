"""Which records are still live, judged by the dates of the scrapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scrapes looked at, age in days and rank a scrape must reach to be the limit.
SCRAPES_KEPT = 60
MIN_AGE_DAYS = 60
MIN_RANK = 3


def scrape_dates(records: DataFrame, updated: str = "meta_updated") -> DataFrame:
    """The newest distinct days on which records were updated."""
    return (
        records.select(F.to_date(updated).alias("scrape_date"))
        .distinct()
        .orderBy(F.desc("scrape_date"))
        .limit(SCRAPES_KEPT)
    )


def expiry_cutoff(dates: DataFrame) -> DataFrame:
    """One row: the last scrape and the day after which a record must have been seen.

    The limit is the newest scrape at least 60 days before the last and at least third
    newest; with none, the oldest; with fewer than three scrapes, the day before that.
    Ranking runs over at most ``SCRAPES_KEPT`` rows.
    """
    newest_first = Window.orderBy(F.desc("scrape_date"))
    ranked = dates.select(
        "scrape_date",
        F.row_number().over(newest_first).alias("rank"),
        F.max("scrape_date").over(Window.partitionBy()).alias("last"),
    )
    old_enough = (F.col("rank") >= MIN_RANK) & (
        F.col("scrape_date") <= F.date_sub("last", MIN_AGE_DAYS)
    )
    found = F.coalesce(F.max(F.when(old_enough, F.col("scrape_date"))), F.min("scrape_date"))
    return ranked.agg(
        F.max("scrape_date").alias("last_scrape"),
        F.when(F.count(F.lit(1)) < MIN_RANK, F.date_sub(found, 1))
        .otherwise(found)
        .alias("cutoff"),
    )


def live_records(records: DataFrame, updated: str = "meta_updated") -> DataFrame:
    """Records seen after the expiry cutoff; the cutoff is a scalar subquery of the filter."""
    cutoff = expiry_cutoff(scrape_dates(records, updated)).select("cutoff").scalar()
    return records.where(F.col(updated) > cutoff.cast("timestamp"))
