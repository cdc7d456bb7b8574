"""The paper's extract: one row per study by counting rules of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.operators.rollup import trial_status_code, unanimity, unnest_sponsors

# Columns of the extract.
PAPER_COLUMNS = [
    "trial_id",
    "number_of_countries",
    "min_end_date",
    "max_end_date",
    "comp_date",
    "has_results",
    "includes_pip",
    "rare_disease",
    "phase",
    "bioequivalence_study",
    "health_volunteers",
    "trial_status",
    "any_terminated",
    "all_terminated",
    "sponsor_status",
    "name_of_sponsor",
]


def paper_sponsors(records: DataFrame) -> DataFrame:
    """Sponsor status and one (the largest) name per study; no row without sponsors.

    Unlike the study table, an empty status counts as blank.
    """
    counts = (
        unnest_sponsors(records, keep_empty=False)
        .groupBy(F.col("eudract_number").alias("trial_id"))
        .agg(
            F.expr("count(*) AS total"),
            F.expr("count_if(status_of_the_sponsor = 'Non-Commercial') AS non_commercial"),
            F.expr("count_if(status_of_the_sponsor = 'Commercial') AS commercial"),
            F.expr("count_if(coalesce(status_of_the_sponsor, '') = '') AS blank"),
            F.expr("max(name_of_sponsor) AS name_of_sponsor"),
        )
    )
    code = F.expr(unanimity("total", [("non_commercial", 0), ("commercial", 1), ("blank", 3)], 2))
    return counts.select("trial_id", code.alias("sponsor_status"), "name_of_sponsor")


def paper_extract(records: DataFrame) -> DataFrame:
    """Raw country-level records (unique by key) -> one row per study.

    Results of any country count, and the codes test for "no" before "yes".
    """

    end = "date_of_the_global_end_of_the_trial"
    rare = "trial_condition_being_studied_is_a_rare_disease"
    counted = {
        "number_of_countries": "count(eudract_number_with_country)",
        "min_end_date": f"min({end})",
        "max_end_date": f"max({end})",
        "comp_date": f"count({end})",
        "results": "count(trial_results)",
        "completed": "count_if(end_of_trial_status = 'Completed')",
        "ongoing": "count_if(end_of_trial_status IN ('Ongoing', 'Restarted'))",
        "terminated": "count_if(end_of_trial_status = 'Prematurely Ended')",
        "blank": "count_if(end_of_trial_status IS NULL)",
        "pip": "count_if(trial_is_part_of_a_paediatric_investigation_plan)",
        "rare_no": f"count_if({rare} = 'No')",
        "rare_yes": f"count_if({rare} = 'Yes')",
        "rare_blank": f"count_if({rare} = 'Information not present in EudraCT')",
        "phase_1": "count_if(trial_human_pharmacology_phase_i)",
        "phase_2": "count_if(trial_therapeutic_exploratory_phase_ii)",
        "phase_3": "count_if(trial_therapeutic_confirmatory_phase_iii)",
        "phase_4": "count_if(trial_therapeutic_use_phase_iv)",
        "be_no": "count_if(NOT trial_bioequivalence_study)",
        "be_yes": "count_if(trial_bioequivalence_study)",
        "hv_no": "count_if(NOT subject_healthy_volunteers)",
        "hv_yes": "count_if(subject_healthy_volunteers)",
    }
    total, done = "number_of_countries", "(completed + terminated)"
    codes = {
        "has_results": "if(results > 0, 1, 0)",
        "includes_pip": "if(pip > 0, 1, 0)",
        "rare_disease": unanimity(total, [("rare_no", 0), ("rare_yes", 1), ("rare_blank", 3)], 2),
        "phase": unanimity(total, [(f"phase_{p}", p) for p in (1, 2, 3, 4)], 0),
        "bioequivalence_study": unanimity(total, [("be_no", 0), ("be_yes", 1)], 2),
        "health_volunteers": unanimity(total, [("hv_no", 0), ("hv_yes", 1)], 2),
        "trial_status": trial_status_code(total, "ongoing", done, "blank"),
        "any_terminated": "if(terminated > 0, 1, 0)",
        "all_terminated": f"if(terminated = {total}, 1, 0)",
    }
    counts = records.groupBy(F.col("eudract_number").alias("trial_id")).agg(
        *[F.expr(f"{sql} AS {name}") for name, sql in counted.items()]
    )
    studies = counts.selectExpr(
        "trial_id",
        *["number_of_countries", "min_end_date", "max_end_date", "comp_date"],
        *[f"{sql} AS {name}" for name, sql in codes.items()],
    )
    return studies.join(paper_sponsors(records), "trial_id", "left").select(*PAPER_COLUMNS)
