"""Distinct counts that can be merged: sketches by scrape and sponsor, added up later without the studies.

The exact counts of ``headline`` need all studies again when scrapes or sponsors are put together; sketches of some
kilobytes each do not. With ``LG_K`` = 14 an estimate is within 2.5 % in all but one of a few hundred cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def headline_groups() -> dict[str, Column]:
    """Groups of studies that the headline counts."""
    due = F.col("results_expected") == 1
    return {
        "total_trials": F.lit(True),
        "due_trials": due,
        "due_trials_with_results": due & (F.col("has_results") == 1),
    }


def study_sketches(
    trials: DataFrame, by: list[str], groups: dict[str, Column] | None = None
) -> DataFrame:
    """One sketch of study ids for each group of studies and each value of ``by``."""
    groups = headline_groups() if groups is None else groups
    return trials.groupBy(*by).agg(
        *(
            F.hll_sketch_agg(F.when(condition, F.col("trial_id")), F.lit(LG_K)).alias(name)
            for name, condition in groups.items()
        )
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of all rows that share ``by``; a study that is in several of them counts once."""
    names = [f.name for f in sketches.schema if f.dataType.simpleString() == "binary"]
    return sketches.groupBy(*by).agg(*(F.hll_union_agg(c).alias(c) for c in names))


def estimates(sketches: DataFrame) -> DataFrame:
    """Sketches as numbers of distinct studies."""
    names = [f.name for f in sketches.schema if f.dataType.simpleString() == "binary"]
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in names})
