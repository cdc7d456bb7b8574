"""Sponsor normalisation and the sponsor table with parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.functions.labels import DUE_STATUSES, INCONSISTENT_STATUSES
from duelens.functions.numbers import percent
from duelens.functions.text import web_slug
from duelens.operators.lookup import lookup_join, salted_join
from duelens.operators.staging import staged

# Columns taken from the reviewed sheet of sponsor names.
SHEET_COLUMNS = [
    "name_of_sponsor",
    "normalized_name",
    "normalized_parent_name",
    "Proof",
    "Description",
    "Notes",
]

# Smallest number of studies of a major sponsor, and a name that never is one.
MAJOR_THRESHOLD = 50
UNKNOWN_SPONSOR = "Unknown Sponsor"


def with_slugs(sheet: DataFrame) -> DataFrame:
    """Reviewed names with the slugs of the raw, the normalised and the parent name."""
    return sheet.select(*SHEET_COLUMNS).withColumns(
        {
            "raw_slug": web_slug(F.col("name_of_sponsor")),
            "slug": web_slug(F.col("normalized_name")),
            "parent_slug": web_slug(F.col("normalized_parent_name")),
        }
    )


def gated_slugs(slugged_sheet: DataFrame) -> DataFrame:
    """The same sheet; a raw slug that occurs twice stops the job when the sheet is read.

    It would multiply the rows of its studies.
    """
    rest = [c for c in slugged_sheet.columns if c != "raw_slug"]
    grouped = slugged_sheet.groupBy("raw_slug").agg(
        F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in rest]
    )
    repeated = F.raise_error(F.concat(F.lit("raw names with the same slug: "), "raw_slug"))
    checked = F.when(F.col("times") > 1, repeated.cast("boolean")).otherwise(F.lit(True))
    return grouped.where(checked).select(*slugged_sheet.columns)


def match_sponsors(trials: DataFrame, slugged_sheet: DataFrame) -> DataFrame:
    """Every study row with its normalised sponsor; '' where the sheet has no such name.

    The raw name becomes ``name_of_sponsor_orig``.
    """
    name = F.coalesce("name_of_sponsor", F.lit(""))
    raw = trials.withColumn("name_of_sponsor_orig", name).drop("name_of_sponsor")
    raw = raw.withColumn("raw_slug", web_slug(F.col("name_of_sponsor_orig")))
    matched = lookup_join(raw, slugged_sheet, ["raw_slug"], "left")
    return matched.na.fill("", [*SHEET_COLUMNS, "slug", "parent_slug"])


def match_distinct(names: DataFrame, slugged_sheet: DataFrame) -> DataFrame:
    """Each distinct raw name with its normalised sponsor."""
    raw = names.select(F.coalesce("name_of_sponsor", F.lit("")).alias("name_of_sponsor"))
    return match_sponsors(raw.distinct(), slugged_sheet)


def with_matched(names: DataFrame, matched: DataFrame, how: str = "inner") -> DataFrame:
    """``names`` with the columns of their ``matched`` names; names that are not there are left out (or stay, ``left``)."""
    raw = names.withColumn("name_of_sponsor_orig", F.coalesce("name_of_sponsor", F.lit("")))
    return lookup_join(raw.drop("name_of_sponsor"), matched, ["name_of_sponsor_orig"], how)


def match_names(names: DataFrame, slugged_sheet: DataFrame) -> DataFrame:
    """``match_sponsors`` with the slug of each distinct raw name formed and looked up once.

    ``names`` is read twice, so it should be a written table.
    """
    return with_matched(names, match_distinct(names, slugged_sheet))


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("normalized_name") == "")


def one_row_per_sponsor(matched: DataFrame) -> DataFrame:
    """One row per sponsor slug and study: the largest value of every other column."""
    keys = ["slug", "trial_id"]
    rest = [c for c in matched.columns if c not in keys]
    return matched.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])


def with_total_trials(trials: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Number of studies of the sponsor on every row.

    A count joined back with salt: a window by sponsor would put all rows of a very
    large sponsor into one task.  ``pairs`` may give the (slug, trial_id) rows to count
    where they are cheaper to have than ``trials``.
    """
    counted = trials if pairs is None else pairs
    totals = counted.groupBy("slug").agg(F.count("trial_id").alias("total_trials"))
    return salted_join(trials, totals, ["slug"], ["trial_id"])


def sponsor_parent_counts(trials: DataFrame) -> DataFrame:
    """Partial counts by sponsor and parent, the only pass over the study rows.

    All sponsor tables below are built from this small table.
    """
    due = F.col("overall_status").isin(DUE_STATUSES)
    return trials.groupBy("slug", "parent_slug", "normalized_parent_name").agg(
        F.max("normalized_name").alias("sponsor_name"),
        F.sum(F.when(due, F.col("results_expected")).otherwise(0)).alias("total_due"),
        F.sum(F.when(due, F.col("has_results")).otherwise(0)).alias("total_reported"),
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(F.col("overall_status").isin(INCONSISTENT_STATUSES)).alias(
            "inconsistent_trials"
        ),
    )


def sponsor_edges(counts: DataFrame) -> DataFrame:
    """Distinct (sponsor, parent) pairs, a sponsor that is its own parent left out."""
    return (
        counts.where(F.col("slug") != F.col("parent_slug"))
        .groupBy("slug", "parent_slug")
        .agg(
            F.max("sponsor_name").alias("sponsor_name"),
            F.max("normalized_parent_name").alias("parent_name"),
        )
    )


def parent_only_sponsors(counts: DataFrame) -> DataFrame:
    """Parents that have no studies of their own, with zero counts."""
    own = counts.select("slug").distinct()
    parents = counts.groupBy(F.col("parent_slug").alias("slug")).agg(
        F.max("normalized_parent_name").alias("sponsor_name")
    )
    zero = F.lit(0).cast("long")
    return parents.join(own, "slug", "left_anti").select(
        "slug",
        "sponsor_name",
        zero.alias("total_due"),
        zero.alias("total_reported"),
        zero.alias("total_trials"),
        zero.alias("inconsistent_trials"),
    )


def sponsor_totals(counts: DataFrame) -> DataFrame:
    """Counts per sponsor, parents without own studies included."""
    own = counts.groupBy("slug").agg(
        F.max("sponsor_name").alias("sponsor_name"),
        F.sum("total_due").alias("total_due"),
        F.sum("total_reported").alias("total_reported"),
        F.sum("total_trials").alias("total_trials"),
        F.sum("inconsistent_trials").alias("inconsistent_trials"),
    )
    return own.unionByName(parent_only_sponsors(counts))


def with_measures(totals: DataFrame, threshold: int = MAJOR_THRESHOLD) -> DataFrame:
    """Derived counts, percentages and the major flag."""
    due, reported = F.col("total_due"), F.col("total_reported")
    bad, total = F.col("inconsistent_trials"), F.col("total_trials")
    major = (total >= threshold) & (due > 0) & (F.col("sponsor_name") != UNKNOWN_SPONSOR)
    return totals.withColumns(
        {
            "not_yet_due_trials": total - due - bad,
            "total_unreported": due - reported,
            "percent_reported": percent(reported, due),
            "percent_unreported": percent(due - reported, due),
            "percent_bad_data": percent(bad, total),
            "major": F.when(major, 1).otherwise(0),
        }
    )


def with_family(measures: DataFrame, edges: DataFrame) -> DataFrame:
    """Sponsors with their lists of parents and of children, both sorted by slug.

    The lists are built from distinct sponsor pairs, never from study rows.
    ``sponsor_edges`` has the same facts as a flat table.
    """

    def relatives(own: str, other: str, other_name: str, name: str) -> DataFrame:
        entry = F.struct(F.col(other).alias("slug"), F.col(other_name).alias("name"))
        return edges.groupBy(F.col(own).alias("slug")).agg(
            F.array_sort(F.collect_list(entry)).alias(name)
        )

    parents = relatives("slug", "parent_slug", "parent_name", "parents")
    children = relatives("parent_slug", "slug", "sponsor_name", "children")
    none = F.array().cast("array<struct<slug:string,name:string>>")
    return (
        measures.join(parents, "slug", "left")
        .join(children, "slug", "left")
        .withColumns(
            {
                "parents": F.coalesce("parents", none),
                "children": F.coalesce("children", none),
            }
        )
    )


def sponsor_table(trials: DataFrame, threshold: int = MAJOR_THRESHOLD) -> DataFrame:
    """The published sponsor table from classified study rows.

    The counts are written once: totals, parents and both lists are made of them, and
    each would otherwise go over the study rows again.
    """
    counts = staged(sponsor_parent_counts(trials))
    measures = with_measures(sponsor_totals(counts), threshold)
    return with_family(measures, sponsor_edges(counts))
