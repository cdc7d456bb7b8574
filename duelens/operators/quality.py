"""Gates and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateFailed(Exception):
    """A data-quality gate found rows it must not find."""

    def __init__(self, message: str, rows: DataFrame):
        super().__init__(message)
        self.rows = rows


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def grandparents(sheet: DataFrame) -> DataFrame:
    """Names that have another name as parent and are themselves another name's parent."""
    differing = sheet.where(F.col("normalized_name") != F.col("normalized_parent_name"))
    children = differing.select(F.col("normalized_name").alias("name"))
    parents = differing.select(F.col("normalized_parent_name").alias("name"))
    return children.intersect(parents)


def worklist(matched: DataFrame) -> DataFrame:
    """Raw names to be reviewed, one row each, with the number of studies they occur in."""
    return matched.groupBy("raw_slug").agg(
        F.count_distinct("trial_id").alias("trials"),
        F.max("name_of_sponsor_orig").alias("name_of_sponsor"),
        *[
            F.max(c).alias(c)
            for c in (
                "normalized_name",
                "normalized_parent_name",
                "Proof",
                "Description",
                "Notes",
            )
        ],
    )


def worklist_trials(matched: DataFrame) -> DataFrame:
    """The studies of each raw name, one row for each name and study."""
    return matched.select("raw_slug", "trial_id").distinct()


def sorted_worklist(rows: DataFrame) -> DataFrame:
    return rows.orderBy(
        "normalized_parent_name", "normalized_name", "name_of_sponsor", "raw_slug"
    )


def study_rules() -> dict[str, Column]:
    """Conditions every classified study row must meet."""
    return {
        "results_expected_is_0_or_1": F.col("results_expected").isin(0, 1),
        "exempt_is_0_or_1": F.col("exempt").isin(0, 1),
        "trial_status_is_0_to_4": F.col("trial_status").isin(0, 1, 2, 3, 4),
        "date_while_ongoing_needs_status_0_or_2": (F.col("comp_date_while_ongoing") == 0)
        | F.col("trial_status").isin(0, 2),
        "no_date_when_completed_needs_status_1": (F.col("all_completed_no_comp_date") == 0)
        | (F.col("trial_status") == 1),
    }


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, counted in one pass: (rule, violations)."""
    counted = rows.agg(
        *[
            F.count_if(~F.coalesce(condition, F.lit(False))).alias(name)
            for name, condition in rules.items()
        ]
    )
    return counted.unpivot([], list(rules), "rule", "violations")


def with_assertions(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The same rows; a row that breaks a rule stops the job when it is computed."""
    checks = [
        F.when(~F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(f"rule broken: {name}")))
        for name, condition in rules.items()
    ]
    return rows.where(F.coalesce(*[c.cast("boolean") for c in checks], F.lit(True)))


def total_conflicts(rows: DataFrame) -> DataFrame:
    """Sponsors whose rows do not agree on one total."""
    return (
        rows.groupBy("slug")
        .agg(F.min("total_trials").alias("lowest"), F.max("total_trials").alias("highest"))
        .where(F.col("lowest") != F.col("highest"))
    )


def require_empty(rows: DataFrame, message: str) -> None:
    """Stop with ``GateFailed`` if there is any row."""
    if not rows.isEmpty():
        raise GateFailed(message, rows)
