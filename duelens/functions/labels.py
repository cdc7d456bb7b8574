"""Code lists and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the study-cohort codes.
NO_YES = {0: "no", 1: "yes"}
SPONSOR_STATUS = {0: "noncommercial", 1: "commercial", 2: "mixed/unclear", 3: "blank"}
PHASE = {0: "discordant", 1: "1", 2: "2", 3: "3", 4: "4"}
RARE_DISEASE = {0: "no", 1: "yes", 2: "discordant", 3: "data_not_available"}
TRIAL_STATUS = {
    0: "all_ongoing",
    1: "all complete (or terminated)",
    2: "any complete (or terminated)",
    3: "other(suspended)",
    4: "blank",
}
COUNTRY_COUNT = {1: "1", 2: "2", 3: "3+"}
BAD_SPONSOR = {0: "Fine", 1: "No Sponsor Name Given", 2: "Unclear Sponsor Name Given"}

COHORT_LABELS = {
    "results": NO_YES,
    "any_terminated": NO_YES,
    "all_terminated": NO_YES,
    "multiple_sponsors": NO_YES,
    "includes_pip": NO_YES,
    "sponsor_status": SPONSOR_STATUS,
    "phase": PHASE,
    "rare_disease": RARE_DISEASE,
    "trial_status": TRIAL_STATUS,
    "country_count": COUNTRY_COUNT,
    "bad_sponsor": BAD_SPONSOR,
}

# Overall statuses by category.
DUE_STATUSES = ["reported", "completed-due"]
NOT_YET_DUE_STATUSES = [
    "ongoing",
    "ongoing-reported-early",
    "exempt",
    "exempt-with-results",
    "completed-not-due",
    "completed-reported-early",
    "other",
]
INCONSISTENT_STATUSES = [
    "error-completed-no-comp-date",
    "outside-eu",
    "partly-outside-eu",
    "error-ongoing-has-comp-date",
    "no-trial-status",
]

# What the published tables say for each overall status.
STATUS_TEXT = {
    "reported": "Reported results",
    "completed-due": "Not reported",
    "ongoing": "Ongoing",
    "ongoing-reported-early": "Ongoing, reported early",
    "exempt": "Exempt",
    "exempt-with-results": "Exempt, with results",
    "completed-not-due": "Completed, report not yet due",
    "completed-reported-early": "Completed, reported early",
    "other": "Other",
    "error-ongoing-has-comp-date": "Listed as ongoing, but also has a completion date",
    "error-completed-no-comp-date": "Completed, but no date",
    "no-trial-status": "No trial status on register",
    "outside-eu": "Trial is outside EEC",
    "partly-outside-eu": "Trial is partly outside EEC",
}
WITH_RESULTS_SUFFIX = {
    "error-ongoing-has-comp-date": " and reported results",
    "error-completed-no-comp-date": ", and reported results",
    "no-trial-status": ", and reported results",
    "outside-eu": ", and reported results",
    "partly-outside-eu": ", and reported results",
}
TERMINATED_TAG = "Terminated"
UNKNOWN_STATUS_TEXT = "internal error"


def label(code: Column, texts: dict) -> Column:
    """Text of a code; a code outside the list has none."""
    chain = None
    for key, text in texts.items():
        chain = F.when(code == key, text) if chain is None else chain.when(code == key, text)
    return chain


def status_category(overall_status: Column) -> Column:
    return (
        F.when(overall_status.isin(DUE_STATUSES), "due-trials")
        .when(overall_status.isin(NOT_YET_DUE_STATUSES), "not-yet-due")
        .otherwise("bad-data")
    )


def status_text(overall_status: Column, has_results: Column) -> Column:
    """Published text of a status, saying so where results exist all the same."""
    suffix = F.when(
        has_results == 1, F.coalesce(label(overall_status, WITH_RESULTS_SUFFIX), F.lit(""))
    ).otherwise("")
    return F.concat(
        F.coalesce(label(overall_status, STATUS_TEXT), F.lit(UNKNOWN_STATUS_TEXT)), suffix
    )


def terminated_tag(all_terminated: Column) -> Column:
    return F.when(all_terminated == 1, TERMINATED_TAG).otherwise("")
