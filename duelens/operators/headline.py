"""Headline figures of one scrape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.functions.labels import INCONSISTENT_STATUSES
from duelens.functions.numbers import percent


def study_counts(trials: DataFrame) -> DataFrame:
    """Distinct studies in each headline group, as one row.

    Studies are made unique by one aggregation on their id; several distinct counts
    side by side would multiply the rows instead.
    """
    due = F.col("results_expected") == 1
    per_study = trials.groupBy("trial_id").agg(
        F.max(due).alias("due"),
        F.max(due & (F.col("has_results") == 1)).alias("with_results"),
        F.max(due & (F.col("has_results") == 0)).alias("without_results"),
        F.max(F.col("overall_status").isin(INCONSISTENT_STATUSES)).alias("inconsistent"),
    )
    return per_study.agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if("due").alias("due_trials"),
        F.count_if("with_results").alias("due_trials_with_results"),
        F.count_if("without_results").alias("due_trials_without_results"),
        F.count_if("inconsistent").alias("inconsistent_trials"),
    )


def sponsor_counts(sponsors: DataFrame) -> DataFrame:
    return sponsors.agg(
        F.count(F.lit(1)).alias("all_sponsors_count"),
        F.count_if(F.col("major") == 1).alias("major_sponsors_count"),
    )


def headline(
    trials: DataFrame, sponsors: DataFrame, scrape_date: Column, cutoff: Column
) -> DataFrame:
    """One row of headline figures; both inputs are reduced to one row before they meet."""
    sponsor_row = sponsor_counts(sponsors)
    return study_counts(trials).select(
        scrape_date.alias("scrape_date"),
        cutoff.alias("due_date_cutoff"),
        "*",
        percent(F.col("due_trials_with_results"), F.col("due_trials")).alias(
            "percent_with_results"
        ),
        percent(F.col("inconsistent_trials"), F.col("total_trials")).alias("percent_inconsistent"),
        sponsor_row.select("all_sponsors_count").scalar().alias("all_sponsors_count"),
        sponsor_row.select("major_sponsors_count").scalar().alias("major_sponsors_count"),
    )
