"""Overall status of a study and what it is called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.functions import labels


# The status shown for a study; the first rule that holds decides.
OVERALL_STATUS = """
CASE
  WHEN only_non_eu = 1 THEN 'outside-eu'
  WHEN contains_non_eu = 1 THEN 'partly-outside-eu'
  WHEN exempt = 1 AND has_results = 1 THEN 'exempt-with-results'
  WHEN exempt = 1 THEN 'exempt'
  WHEN trial_status IN (0, 2) THEN
    CASE WHEN comp_date_while_ongoing = 1 THEN 'error-ongoing-has-comp-date'
         WHEN has_results = 1 THEN 'ongoing-reported-early'
         ELSE 'ongoing' END
  WHEN trial_status = 1 THEN
    CASE WHEN all_completed_no_comp_date = 1 THEN 'error-completed-no-comp-date'
         WHEN results_expected = 0 AND has_results = 1 THEN 'completed-reported-early'
         WHEN results_expected = 0 THEN 'completed-not-due'
         WHEN has_results = 1 THEN 'reported'
         ELSE 'completed-due' END
  WHEN trial_status = 3 THEN 'other'
  WHEN trial_status = 4 THEN 'no-trial-status'
END"""


def with_overall_status(studies: DataFrame) -> DataFrame:
    return studies.withColumn("overall_status", F.expr(OVERALL_STATUS))


def with_labels(studies: DataFrame) -> DataFrame:
    """Category, published text and the extra tag of every classified study."""
    return studies.withColumns(
        {
            "category": labels.status_category(F.col("overall_status")),
            "status_text": labels.status_text(F.col("overall_status"), F.col("has_results")),
            "terminated_tag": labels.terminated_tag(F.col("all_terminated")),
        }
    )
