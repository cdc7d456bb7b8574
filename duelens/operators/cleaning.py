"""Cleaning of country-level records: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duelens.functions import flags
from duelens.schema import RECORD_KEY

# Source column -> flag of the same name.
TRUE_FLAGS = [
    "trial_is_part_of_a_paediatric_investigation_plan",
    "trial_human_pharmacology_phase_i",
    "trial_therapeutic_exploratory_phase_ii",
    "trial_therapeutic_confirmatory_phase_iii",
    "trial_therapeutic_use_phase_iv",
    "trial_bioequivalence_study",
    "trial_single_blind",
    "subject_healthy_volunteers",
]

# Flag for an explicit "no" -> source column.
FALSE_FLAGS = {
    "not_bioequivalence_study": "trial_bioequivalence_study",
    "not_single_blind": "trial_single_blind",
    "not_healthy_volunteers": "subject_healthy_volunteers",
}

RARE_COLUMN = "trial_condition_being_studied_is_a_rare_disease"

RENAMED = {
    "full_title_of_the_trial": "full_title",
    "name_or_abbreviated_title_of_the_trial_where_available": "abbreviated_title",
}


def clean_records(records: DataFrame) -> DataFrame:
    """Turn the register's three-valued fields into 0/1 flags and their opposites."""
    date, rare, key = "date_of_the_global_end_of_the_trial", RARE_COLUMN, RECORD_KEY
    changed = {name: f"cast(coalesce({name}, false) AS int)" for name in TRUE_FLAGS}
    changed[rare] = f"cast({rare} <=> '{flags.RARE_YES}' AS int)"
    changed["trial_results"] = "cast(trial_results IS NOT NULL AS int)"
    changed[date] = f"to_date({date})"
    added = {
        name: f"cast(coalesce(NOT {source}, false) AS int)" for name, source in FALSE_FLAGS.items()
    }
    added["not_rare_disease"] = f"cast({rare} <=> '{flags.RARE_NO}' AS int)"
    added["rare_disease_blank"] = f"cast({rare} <=> '{flags.RARE_BLANK}' AS int)"
    added["non_eu"] = f"cast(coalesce(contains({key}, '{flags.OUTSIDE_AREA_MARK}'), false) AS int)"
    kept = [f"{changed.get(c, c)} AS {RENAMED.get(c, c)}" for c in records.columns]
    return records.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in added.items()])
