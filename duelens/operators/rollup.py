"""Country records -> studies: one hash aggregation by study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.functions import text
from duelens.operators.cleaning import RARE_COLUMN
from duelens.schema import RECORD_KEY

# Status texts counted together. 'Withdrawn' belongs to no group.
STATUS_GROUPS = {
    "completed": ["Completed"],
    "ongoing": ["Ongoing", "Restarted"],
    "terminated": ["Prematurely Ended"],
    "suspended": ["Temporarily Halted", "Suspended by CA"],
    "other_status": ["Not Authorised", "Prohibited by CA"],
}

# Summed flag -> source column.
SUMMED_FLAGS = {
    "includes_pip": "trial_is_part_of_a_paediatric_investigation_plan",
    "has_results": "trial_results",
    "single_blind": "trial_single_blind",
    "not_single_blind": "not_single_blind",
    "rare_disease": RARE_COLUMN,
    "not_rare_disease": "not_rare_disease",
    "rare_disease_blank": "rare_disease_blank",
    "phase_1": "trial_human_pharmacology_phase_i",
    "phase_2": "trial_therapeutic_exploratory_phase_ii",
    "phase_3": "trial_therapeutic_confirmatory_phase_iii",
    "phase_4": "trial_therapeutic_use_phase_iv",
    "bioequivalence": "trial_bioequivalence_study",
    "not_bioequivalence": "not_bioequivalence_study",
    "healthy_volunteers": "subject_healthy_volunteers",
    "not_healthy_volunteers": "not_healthy_volunteers",
    "non_eu": "non_eu",
}

# Fixed value: where a study's page is found.
STUDY_URL = "https://www.clinicaltrialsregister.eu/ctr-search/search?query="

# Column order of the study table.
TRIAL_COLUMNS = [
    "trial_id",
    "number_of_countries",
    "min_end_date",
    "max_end_date",
    "comp_date",
    "has_results",
    "includes_pip",
    "exempt",
    "single_blind",
    "rare_disease",
    "phase",
    "bioequivalence_study",
    "health_volunteers",
    "trial_status",
    "any_terminated",
    "all_terminated",
    "results_expected",
    "all_completed_no_comp_date",
    "sponsor_status",
    "name_of_sponsor",
    "trial_title",
    "trial_url",
    "comp_date_while_ongoing",
    "contains_non_eu",
    "only_non_eu",
]


def latest_by_key(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the largest ``order`` (later columns break ties).

    A partial aggregate, so a key with very many copies shrinks before the shuffle.
    """
    rest = [c for c in records.columns if c not in keys]
    tail = [c for c in rest if c not in order]
    best = records.groupBy(*keys).agg(F.max(F.struct(*order, *tail)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def by_study(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Records dealt by study: key reduction, roll-up and sponsor names need no further exchange.

    A study has a few records for each country, so none is too large for a task. ``parts`` partitions are
    kept as they are; without it, small ones are merged.
    """
    return records.repartition(*([parts] if parts else []), "eudract_number")


def unique_records(
    records: DataFrame, key: str = RECORD_KEY, study: str | None = None
) -> DataFrame:
    """One row per record key, the largest by all other columns if a key is repeated.

    The roll-up counts rows, so a repeated key would change every code of its study.  ``study`` names the
    column that ``records`` are dealt by, if they are; a key belongs to one study.
    """
    keys = [study, key] if study else [key]
    rest = [c for c in records.columns if c not in keys]
    largest = records.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("largest"))
    return largest.select(*[F.col(c if c in keys else f"largest.{c}") for c in records.columns])


# Per record: the rows its sponsor list unnests to, and how many have each status.  A
# record without sponsors counts as one row with a blank status.
SPONSOR_COUNTS = {
    "sponsor_rows": "greatest(coalesce(size(sponsors), 0), 1)",
    "commercial": """coalesce(size(sponsors.status_of_the_sponsor)
        - size(array_remove(sponsors.status_of_the_sponsor, 'Commercial')), 0)""",
    "non_commercial": """coalesce(size(sponsors.status_of_the_sponsor)
        - size(array_remove(sponsors.status_of_the_sponsor, 'Non-Commercial')), 0)""",
    "blank_status": """CASE WHEN coalesce(size(sponsors), 0) <= 0 THEN 1 ELSE size(filter(sponsors,
        s -> s.status_of_the_sponsor IS NULL)) END""",
}


def unanimity(total: str, counts: list[tuple[str, int]], default: int) -> str:
    """SQL for the code of the first count that equals the total, else ``default``."""
    cases = " ".join(f"WHEN {count} = {total} THEN {code}" for count, code in counts)
    return f"CASE {cases} ELSE {default} END"


def trial_status_code(total: str, ongoing: str, done: str, blank: str) -> str:
    """SQL: 0 all ongoing, 1 all done, 2 some done, 4 all blank, 3 anything else."""
    return f"""CASE WHEN {ongoing} = {total} THEN 0 WHEN {done} = {total} THEN 1
        WHEN {done} > 0 AND {done} < {total} THEN 2 WHEN {blank} = {total} THEN 4 ELSE 3 END"""


def flag(condition: str) -> str:
    """SQL for a condition as 0/1, an unknown condition counting as 0."""
    return f"cast(coalesce({condition}, false) AS int)"


# Per record: the names its sponsor list unnests to; a record without sponsors has one blank.
SPONSOR_NAMES = """CASE WHEN coalesce(size(sponsors), 0) > 0
    THEN sponsors.name_of_sponsor ELSE array(cast(NULL AS string)) END"""


def roll_up(cleaned: DataFrame, names: bool = False) -> DataFrame:
    """Sums and extremes per study over cleaned records that are unique by record key.

    The counts of sponsor statuses ride along, and with ``names`` the distinct raw sponsor names
    (``sponsor_names``, as many as a study has), so sponsors need no second pass.
    """
    end, status = "date_of_the_global_end_of_the_trial", "end_of_trial_status"
    aggregates = {
        "number_of_countries": "count(eudract_number_with_country)",
        "min_end_date": f"min({end})",
        "max_end_date": f"max({end})",
        "comp_date": f"count({end})",
        **{name: f"sum({source})" for name, source in SUMMED_FLAGS.items()},
        **{
            name: f"count_if({status} IN ({', '.join(repr(t) for t in texts)}))"
            for name, texts in STATUS_GROUPS.items()
        },
        "no_status": f"count_if({status} IS NULL)",
    }
    if "full_title" in cleaned.columns:
        aggregates |= {
            "full_title": "min(full_title)",
            "abbreviated_title": "max(abbreviated_title)",
        }
    if "sponsors" in cleaned.columns:
        aggregates |= {name: f"sum({sql})" for name, sql in SPONSOR_COUNTS.items()}
    if names:
        aggregates["sponsor_names"] = f"array_distinct(flatten(collect_list({SPONSOR_NAMES})))"
    return cleaned.groupBy("eudract_number").agg(
        *[F.expr(f"{sql} AS {name}") for name, sql in aggregates.items()]
    )


def _marks() -> dict[str, str]:
    """SQL by name: what the codes of a study ask of all or of any of its records."""
    end, status = "date_of_the_global_end_of_the_trial", "end_of_trial_status"
    of_status = {
        name: f"{status} IN ({', '.join(repr(t) for t in texts)})"
        for name, texts in STATUS_GROUPS.items()
    }
    return {
        **{name: f"{source} = 1" for name, source in SUMMED_FLAGS.items()},
        **of_status,
        "done": f"({of_status['completed']} OR {of_status['terminated']})",
        "no_status": f"{status} IS NULL",
        "comp_date": f"{end} IS NOT NULL",
        **{
            name: f"({SPONSOR_COUNTS[name]}) = ({SPONSOR_COUNTS['sponsor_rows']})"
            for name in ("commercial", "non_commercial")
        },
        # no lambda expression, which would keep the sponsor lists out of generated code
        "blank_status": "coalesce(size(sponsors), 0) <= 0 OR array_max(sponsors.status_of_the_sponsor) IS NULL",
    }


def roll_up_by_name(cleaned: DataFrame) -> DataFrame:
    """One narrow row per study and raw sponsor name; ``merge_names`` makes studies of them.

    Of a study's records the codes only ask whether all or any have a property, so properties are bits of one number
    (``all_marks``, ``any_marks``).  Repeating them for each name of a record changes nothing, and everything fits a
    small hash aggregate, where a list of names makes Spark sort wide buffers.  Records have a key (not null).
    """
    bits = " + ".join(f"if({sql}, {1 << i}L, 0L)" for i, sql in enumerate(_marks().values()))
    marked = cleaned.selectExpr(
        "eudract_number",
        "eudract_number_with_country IS NOT NULL AS keyed",
        "date_of_the_global_end_of_the_trial AS end_date",
        f"{bits} AS marks",
        f"posexplode({SPONSOR_NAMES}) AS (place, name_of_sponsor)",
    )
    return marked.groupBy("eudract_number", "name_of_sponsor").agg(
        F.count_if((F.col("place") == 0) & F.col("keyed")).alias("number_of_countries"),
        F.min("end_date").alias("min_end_date"),
        F.max("end_date").alias("max_end_date"),
        F.bit_and("marks").alias("all_marks"),
        F.bit_or("marks").alias("any_marks"),
    )


def merge_studies(by_name: DataFrame) -> DataFrame:
    """One row per study of ``roll_up_by_name``; with a ``name_number`` for each row also the distinct ``name_numbers``.

    A study has a few names, so that the list is short; rows go by study first, because lists are not made in parts.
    """
    merged = {
        "number_of_countries": F.sum("number_of_countries"),
        "min_end_date": F.min("min_end_date"),
        "max_end_date": F.max("max_end_date"),
        "all_marks": F.bit_and("all_marks"),
        "any_marks": F.bit_or("any_marks"),
    }
    if "name_number" in by_name.columns:
        merged["name_numbers"] = F.collect_set("name_number")
        by_name = by_study(by_name)
    return by_name.groupBy("eudract_number").agg(*[c.alias(name) for name, c in merged.items()])


def merge_names(by_name: DataFrame) -> DataFrame:
    """``merge_studies`` with ``counted_marks``."""
    return counted_marks(merge_studies(by_name))


def counted_marks(merged: DataFrame) -> DataFrame:
    """``roll_up`` as far as codes need it: a count is the number of countries (all), 1 (some) or 0 (none).

    ``done`` counts completed and terminated records together.
    """
    counts = {
        name: F.expr(f"""CASE WHEN all_marks & {1 << i}L <> 0 THEN number_of_countries
            WHEN any_marks & {1 << i}L <> 0 THEN 1L ELSE 0L END""")
        for i, name in enumerate(_marks())
    }
    rolled = merged.withColumns({**counts, "sponsor_rows": F.col("number_of_countries")})
    return rolled.drop("all_marks", "any_marks")


def study_codes(rolled: DataFrame, cutoff: Column, results_rule: str = "all") -> DataFrame:
    """Unanimity codes, due-date rule and titles of every study.

    ``results_rule`` says whether all countries or any country must have results.
    """
    total = "number_of_countries"
    done = "done" if "done" in rolled.columns else "(completed + terminated)"
    exempt = f"(includes_pip = 0 AND phase_1 = {total})"
    results = {"all": f"has_results = {total}", "any": "has_results > 0"}[results_rule]
    codes = {
        "has_results": flag(results),
        "includes_pip": flag("includes_pip > 0"),
        "exempt": flag(exempt),
        "single_blind": unanimity(total, [("single_blind", 1), ("not_single_blind", 0)], 2),
        "rare_disease": unanimity(
            total, [("rare_disease", 1), ("not_rare_disease", 0), ("rare_disease_blank", 3)], 2
        ),
        "phase": unanimity(total, [(f"phase_{p}", p) for p in (1, 2, 3, 4)], 0),
        "bioequivalence_study": unanimity(
            total, [("bioequivalence", 1), ("not_bioequivalence", 0)], 2
        ),
        "health_volunteers": unanimity(
            total, [("healthy_volunteers", 1), ("not_healthy_volunteers", 0)], 2
        ),
        "trial_status": trial_status_code(total, "ongoing", done, "no_status"),
        "any_terminated": flag("terminated > 0"),
        "all_terminated": flag(f"terminated = {total}"),
        "results_expected": flag(
            f"{done} = {total} AND comp_date > 0 AND max_end_date < __cutoff AND NOT {exempt}"
        ),
        "all_completed_no_comp_date": flag(f"{done} = {total} AND comp_date = 0"),
        "comp_date_while_ongoing": flag(f"comp_date > 0 AND {done} > 0 AND {done} < {total}"),
        "contains_non_eu": flag("non_eu > 0"),
        "only_non_eu": flag(f"non_eu = {total}"),
        "trial_url": f"concat('{STUDY_URL}', eudract_number)",
    }
    if "sponsor_rows" in rolled.columns:
        codes["sponsor_status"] = unanimity(
            "sponsor_rows", [("non_commercial", 0), ("commercial", 1), ("blank_status", 3)], 2
        )
    kept = [c for c in rolled.columns if c not in codes and c not in ("eudract_number", "done")]
    coded = rolled.withColumn("__cutoff", cutoff).selectExpr(
        "eudract_number AS trial_id", *kept, *[f"{sql} AS {name}" for name, sql in codes.items()]
    )
    if "full_title" not in kept:
        return coded
    full = text.without_line_breaks(text.null_if_nan_text(F.col("full_title")))
    short = text.null_if_nan_text(F.col("abbreviated_title"))
    return coded.withColumn("trial_title", text.display_title(full, short))


def unnest_sponsors(records: DataFrame, keep_empty: bool = True) -> DataFrame:
    """One row per record and sponsor; ``keep_empty`` keeps records without sponsors."""
    unnest = F.explode_outer if keep_empty else F.explode
    return records.select(
        "eudract_number", "eudract_number_with_country", unnest("sponsors").alias("s")
    ).select(
        "eudract_number",
        "eudract_number_with_country",
        F.col("s.name_of_sponsor").alias("name_of_sponsor"),
        F.col("s.status_of_the_sponsor").alias("status_of_the_sponsor"),
    )


def one_row_per_name(coded: DataFrame) -> DataFrame:
    """One row per study and distinct raw sponsor name, in the study table's column order."""
    rows = coded.withColumn("name_of_sponsor", F.explode("sponsor_names"))
    return rows.select(*TRIAL_COLUMNS)
