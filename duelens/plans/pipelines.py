"""The pipelines: pages -> records -> studies -> published tables; cohorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.functions.dates import due_date_cutoff
from duelens.operators import cohort, quality, rollup, sponsors
from duelens.operators.classify import with_overall_status
from duelens.operators.cleaning import clean_records
from duelens.operators.expiry import expiry_cutoff, live_records, scrape_dates
from duelens.operators.headline import headline
from duelens.operators.lookup import lookup_join
from duelens.operators.staging import staged
from duelens.sources.scans import scan_records
from duelens.sources.sinks import (
    write_csv,
    write_history,
    write_json,
    write_meta_if_changed,
)
from duelens.sources.upsert import upsert_history


def studies(records: DataFrame, cutoff: Column, results_rule: str = "all") -> DataFrame:
    """Country-level records, unique by key -> one classified row per study."""
    rolled = rollup.roll_up(clean_records(records))
    return with_overall_status(rollup.study_codes(rolled, cutoff, results_rule))


def study_table(records: DataFrame, cutoff: Column, results_rule: str = "all") -> DataFrame:
    """Country-level records -> one row per study and raw sponsor name."""
    rolled = rollup.roll_up(clean_records(records), names=True)
    return rollup.one_row_per_name(rollup.study_codes(rolled, cutoff, results_rule))


def build_study_table(warehouse: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The record table with ``meta_updated`` -> (study table, one-row meta).

    Records not seen since the expiry cutoff are left out.  Both dates stay in the plan
    as scalar subqueries, so nothing is read before the result is asked for.
    """
    dates = expiry_cutoff(scrape_dates(warehouse))
    last = dates.select("last_scrape").scalar()
    live = rollup.by_study(live_records(scan_records(warehouse)))
    live = rollup.unique_records(live, study="eudract_number")
    table = study_table(live, due_date_cutoff(last))
    meta = dates.select(
        due_date_cutoff(F.col("last_scrape")).alias("due_date_cutoff"),
        F.current_timestamp().alias("got_from_db"),
        F.col("last_scrape").alias("scrape_date"),
    )
    return table, meta


def write_study_table(
    warehouse: DataFrame, before: DataFrame, table_path: str, meta_path: str
) -> bool:
    """Write the study table as CSV, and its meta row if it differs from ``before``.

    ``before`` is the previous table, kept under another path than ``table_path``.
    """
    table, meta = build_study_table(warehouse)
    table = staged(table)
    write_csv(table, table_path, rollup.TRIAL_COLUMNS)
    return write_meta_if_changed(before, table, meta, meta_path)


def sponsor_trials(
    trials: DataFrame, sheet: DataFrame, on_unmatched: str = "exclude"
) -> DataFrame:
    """Study rows -> one classified row per normalised sponsor and study.

    ``on_unmatched``: 'exclude' leaves rows with names not yet reviewed out,
    'fail' stops with the worklist if there are any.
    """
    slugged = sponsors.with_slugs(sheet)
    matched = sponsors.match_sponsors(trials, slugged)
    if on_unmatched == "fail" and not sponsors.unmatched(matched).isEmpty():
        raise quality.GateFailed(
            "sponsor names without a normalised name", quality.worklist(matched)
        )
    known = matched.where(F.col("normalized_name") != "")
    return with_overall_status(sponsors.one_row_per_sponsor(known))


def sponsor_pairs(unnested: DataFrame, sheet: DataFrame) -> DataFrame:
    """Unnested sponsors and the sheet -> one row per normalised sponsor and study.

    Names not yet reviewed are left out.  The rows hold no study columns yet, so the
    aggregation moves little data; ``with_studies`` adds them afterwards.
    """
    names = unnested.select(F.col("eudract_number").alias("trial_id"), "name_of_sponsor")
    slugged = sponsors.gated_slugs(sponsors.with_slugs(sheet))
    matched = sponsors.match_sponsors(names.distinct(), slugged)
    return sponsors.one_row_per_sponsor(matched.where(F.col("normalized_name") != ""))


def named_studies(
    records: DataFrame, cutoff: Column, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Some columns of the coded and classified studies, and their distinct (trial_id, name_of_sponsor).

    One pass over the records; what it leaves by study and name is written once, because both are made of it.
    """
    rows = staged(rollup.roll_up_by_name(clean_records(records)), wide=True, lookups=True)
    coded = with_overall_status(rollup.study_codes(rollup.merge_names(rows), cutoff))
    names = rows.select(F.col("eudract_number").alias("trial_id"), "name_of_sponsor")
    return coded.select(*columns), names


def reviewed_names(names: DataFrame, sheet: DataFrame) -> DataFrame:
    """(name_of_sponsor_orig, columns of the sheet): each distinct name of ``named_studies`` that has been reviewed.

    Written once: with its size known before a join is planned, (study, name) rows stay where they are if the names are few.
    """
    slugged = sponsors.gated_slugs(sponsors.with_slugs(sheet))
    return staged(sponsors.match_distinct(names, slugged).where(F.col("normalized_name") != ""))


def record_sponsors(
    records: DataFrame, cutoff: Column, sheet: DataFrame, columns: list[str]
) -> DataFrame:
    """One row per normalised sponsor and study with some columns of the study, by one pass over the records."""
    studies, names = named_studies(records, cutoff, columns)
    known = sponsors.with_matched(names, reviewed_names(names, sheet))
    return with_studies(sponsors.one_row_per_sponsor(known), studies)


def with_studies(pairs: DataFrame, classified: DataFrame) -> DataFrame:
    """Sponsor pairs with all columns of their classified study."""
    return pairs.join(classified, "trial_id")


def check_sheet(sheet: DataFrame) -> None:
    """Stop on parents that have parents, and on raw names that share a slug."""
    quality.require_empty(quality.grandparents(sheet), "parents that have parents")
    slugged = sponsors.with_slugs(sheet)
    quality.require_empty(
        quality.duplicate_keys(slugged, ["raw_slug"]), "raw names with the same slug"
    )


@dataclass
class Published:
    """The published tables of one scrape."""

    trials: DataFrame
    sponsors: DataFrame
    headline: DataFrame


def publish(
    trials: DataFrame,
    sheet: DataFrame,
    meta: DataFrame,
    threshold: int = sponsors.MAJOR_THRESHOLD,
    on_unmatched: str = "fail",
) -> Published:
    """Study table, reviewed sheet and meta row -> the three published tables.

    Classified study rows are written once, because all three tables are made of them.
    """
    check_sheet(sheet)
    classified = staged(sponsor_trials(trials, sheet, on_unmatched))
    rules = quality.violations(classified, quality.study_rules())
    quality.require_empty(rules.where(F.col("violations") > 0), "study rows that break a rule")
    sponsor_rows = sponsors.sponsor_table(classified, threshold)
    figures = headline(
        classified,
        sponsor_rows,
        meta.select("scrape_date").scalar(),
        meta.select("due_date_cutoff").scalar(),
    )
    return Published(sponsors.with_total_trials(classified), sponsor_rows, figures)


def write_published(tables: Published, folder: str, history: DataFrame | None = None) -> None:
    """Write the published tables as JSON lines and put this scrape into the history.

    Earlier scrapes stay in ``headline_history``, which ``scans.read_history`` reads; ``history`` are
    rows from elsewhere that go in first.
    """
    write_json(tables.trials, f"{folder}/all_trials", ["trial_id", "slug"])
    write_json(tables.sponsors, f"{folder}/all_sponsors", ["slug"])
    figures = staged(tables.headline)
    write_json(figures, f"{folder}/headline")
    rows = figures if history is None else upsert_history(history, figures)
    write_history(rows, f"{folder}/headline_history")


def study_cohort(
    coded: DataFrame, unnested: DataFrame, sheet: DataFrame, dropped_years: list[int] | None = None
) -> DataFrame:
    """Coded studies, their sponsor rows and the sheet -> cohort rows with size bins.

    The rows are written once: bins, tables and models all read them.
    """
    names = unnested.select(F.col("eudract_number").alias("trial_id"), "name_of_sponsor")
    slugged = sponsors.gated_slugs(sponsors.with_slugs(sheet))
    matched = sponsors.match_sponsors(names.distinct(), slugged)
    known = matched.where(F.col("normalized_name") != "")
    return _binned(cohort.one_row_per_study(coded, known), dropped_years)


def record_cohort(
    records: DataFrame, cutoff: Column, sheet: DataFrame, dropped_years: list[int] | None = None
) -> DataFrame:
    """Records and the sheet -> ``study_cohort`` with the columns cohorts use, by one pass over the records.

    What the pass leaves by study and name is written, names are numbered, and then rows go by study once.
    """
    by_name = staged(rollup.roll_up_by_name(clean_records(records)), wide=True, lookups=True)
    matched = reviewed_names(by_name.select("name_of_sponsor"), sheet)
    matched = matched.select("name_of_sponsor_orig", "normalized_name")
    numbers = cohort.numbered_names(matched)
    numbered = lookup_join(matched, numbers, ["normalized_name"]).drop("normalized_name")
    by_name = sponsors.with_matched(by_name, staged(numbered), "left")
    merged = rollup.counted_marks(staged(rollup.merge_studies(by_name), lookups=True, sort=True))
    coded = rollup.study_codes(merged, cutoff).select(*cohort.STUDY_COLUMNS, "name_numbers")
    return _binned(cohort.with_largest_name(coded, numbers), dropped_years)


def _binned(rows: DataFrame, dropped_years: list[int] | None) -> DataFrame:
    derived = staged(cohort.derive_variables(rows, dropped_years), wide=True, lookups=True)
    return cohort.with_sponsor_size_bins(derived)
