"""Every registered query with, where SQL can express it, the SQL it must agree with.

All of them read the whole test tables.  Dates and lists are returned as text so that any
engine renders them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelens.functions import dates, labels, numbers, text
from duelens.operators import (
    browse,
    cohort,
    expiry,
    extract,
    headline,
    logistic,
    paper,
    quality,
    quantile,
    rollup,
    sponsors,
)
from duelens.operators.classify import with_labels
from duelens.operators.cleaning import clean_records
from duelens.operators.staging import new_path, staged
from duelens.plans import pipelines
from duelens.plans.oracle import cut_points, slug, with_views
from duelens.schema import STUDY_SCAN_COLUMNS
from duelens.sources import record_table, scans, sinks, testbed, upsert
from duelens.streaming import record_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Last end date and first year used with the test tables, whose dates are earlier than
# the register's; the register's own values are the defaults of the operators.
LAST_DAY = (date(2000, 6, 30) - date(1960, 1, 1)).days
FIRST_YEAR = 1996


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a query and its SQL."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return function

    return register


def day_text(column: str | Column) -> Column:
    return F.date_format(F.col(column) if isinstance(column, str) else column, "yyyy-MM-dd")


def with_text_days(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: day_text(n) for n in names})


# --- shared inputs -----------------------------------------------------------------------


def records(spark: SparkSession, folder: str) -> DataFrame:
    return testbed.protocol_records(spark, folder)


def plain_records(spark: SparkSession, folder: str) -> DataFrame:
    return testbed.protocol_records(spark, folder, sponsors=False)


def scraped_records(spark: SparkSession, folder: str) -> DataFrame:
    return testbed.protocol_records(spark, folder, sponsors=False, scrapes=True)


def coded(spark: SparkSession, folder: str) -> DataFrame:
    """Coded and classified studies."""
    return pipelines.studies(records(spark, folder), testbed.cutoff(spark, folder))


def study_rows(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.study_table(records(spark, folder), testbed.cutoff(spark, folder))


def sponsor_pairs(spark: SparkSession, folder: str) -> DataFrame:
    unnested = rollup.unnest_sponsors(records(spark, folder))
    return pipelines.sponsor_pairs(unnested, testbed.sponsor_sheet(spark, folder))


def sponsor_rows(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.with_studies(sponsor_pairs(spark, folder), coded(spark, folder))


def sponsor_table(spark: SparkSession, folder: str) -> DataFrame:
    """Published sponsors without their families."""
    rows = pipelines.record_sponsors(
        records(spark, folder),
        testbed.cutoff(spark, folder),
        testbed.sponsor_sheet(spark, folder),
        ["trial_id", "overall_status", "results_expected", "has_results"],
    )
    counts = staged(sponsors.sponsor_parent_counts(rows))
    return sponsors.with_measures(sponsors.sponsor_totals(counts))


def cohort_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Cohorts use two fields of a sponsor, so the lists hold no others."""
    keys = ["name_of_sponsor", "status_of_the_sponsor"]
    rows = testbed.protocol_records(spark, folder, sponsor_keys=keys)
    return pipelines.record_cohort(
        rows, testbed.cutoff(spark, folder), testbed.sponsor_sheet(spark, folder)
    )


def due_rows(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort(cohort_rows(spark, folder), cohort.due_steps(LAST_DAY))


# --- scans, dates and expiry -------------------------------------------------------------


@query(
    "overall_status_counts",
    "SELECT overall_status, count(*) AS studies FROM classified GROUP BY overall_status",
)
def overall_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = plain_records(spark, folder)
    counted = pipelines.studies(rows, testbed.cutoff(spark, folder))
    return counted.groupBy("overall_status").agg(F.count(F.lit(1)).alias("studies"))


@query(
    "newest_scrape_dates",
    """SELECT DISTINCT o_orderdate::DATE::VARCHAR AS scrape_date FROM orders
    ORDER BY scrape_date DESC LIMIT 60""",
)
def newest_scrape_dates(spark: SparkSession, folder: str) -> DataFrame:
    found = expiry.scrape_dates(testbed.table(spark, folder, "orders"), "o_orderdate")
    return found.select(day_text("scrape_date").alias("scrape_date"))


def _cutoff_sql(day: str, table: str) -> str:
    return f"""
SELECT max(d)::VARCHAR AS last_scrape,
  (CASE WHEN count(*) < 3 THEN (min(d) - INTERVAL 1 DAY)::DATE ELSE
   coalesce(max(d) FILTER (r >= 3 AND d <= last - 60), min(d)) END)::VARCHAR AS cutoff
FROM (SELECT d, row_number() OVER (ORDER BY d DESC) AS r, max(d) OVER () AS last
      FROM (SELECT DISTINCT {day} AS d FROM {table} ORDER BY d DESC LIMIT 60))"""


def _cutoff_text(rows: DataFrame) -> DataFrame:
    return with_text_days(expiry.expiry_cutoff(rows), "last_scrape", "cutoff")


@query("expiry_cutoff_monthly", _cutoff_sql("date_trunc('month', o_orderdate)::DATE", "orders"))
def expiry_cutoff_monthly(spark: SparkSession, folder: str) -> DataFrame:
    orders = testbed.table(spark, folder, "orders")
    months = orders.select(F.date_trunc("month", "o_orderdate").alias("m"))
    return _cutoff_text(expiry.scrape_dates(months, "m"))


@query("expiry_cutoff_daily_orders", _cutoff_sql("o_orderdate::DATE", "orders"))
def expiry_cutoff_daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoff_text(expiry.scrape_dates(testbed.table(spark, folder, "orders"), "o_orderdate"))


@query("expiry_cutoff_daily_events", _cutoff_sql("ts::DATE", "events"))
def expiry_cutoff_daily_events(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoff_text(expiry.scrape_dates(testbed.table(spark, folder, "events"), "ts"))


@query(
    "live_records",
    f"""SELECT r.record_key AS eudract_number_with_country, r.status AS end_of_trial_status,
      date_trunc('month', o_orderdate)::DATE::VARCHAR AS meta_updated
    FROM records r JOIN orders ON o_orderkey = r.o
    WHERE date_trunc('month', o_orderdate)
      > (SELECT cutoff FROM ({_cutoff_sql("date_trunc('month', o_orderdate)::DATE", "orders")}))
      ::DATE""",
)
def live_records(spark: SparkSession, folder: str) -> DataFrame:
    live = expiry.live_records(scraped_records(spark, folder))
    return live.select(
        "eudract_number_with_country",
        "end_of_trial_status",
        day_text("meta_updated").alias("meta_updated"),
    )


@query(
    "due_dates_of_orders",
    """SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 1 YEAR - INTERVAL 28 DAY)::DATE::VARCHAR
      AS due_cutoff, year(o_orderdate)::INT AS order_year,
      (o_orderdate::DATE - DATE '1960-01-01')::INT AS day_number,
      o_orderdate::DATE::VARCHAR AS day_again FROM orders""",
)
def due_dates_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    number = dates.to_day_number(day)
    return testbed.table(spark, folder, "orders").select(
        "o_orderkey",
        day_text(dates.due_date_cutoff(day)).alias("due_cutoff"),
        F.year(day).alias("order_year"),
        number.alias("day_number"),
        day_text(dates.from_day_number(number)).alias("day_again"),
    )


@query(
    "event_properties",
    """SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events""",
)
def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("props", "struct<k:int>")
    return testbed.table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@query(
    "study_table_csv_round_trip",
    """SELECT trial_id, coalesce(name_of_sponsor, '') AS name_of_sponsor,
      coalesce(max_end_date::VARCHAR, '') AS max_end_date, phase, trial_title
    FROM study_names JOIN coded USING (trial_id)""",
)
def study_table_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "study-table-csv")
    sinks.write_csv(study_rows(spark, folder), path, rollup.TRIAL_COLUMNS)
    back = scans.read_trial_csv(spark, path)
    return back.select("trial_id", "name_of_sponsor", "max_end_date", "phase", "trial_title")


@query(
    "sponsor_json_round_trip",
    "SELECT slug, sponsor_name, total_trials, percent_reported FROM sponsors",
)
def sponsor_json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "sponsors-json")
    rows = sponsor_table(spark, folder)
    sinks.write_json(rows, path, ["slug"])
    back = scans.read_json(spark, path, rows.schema)
    return back.select("slug", "sponsor_name", "total_trials", "percent_reported")


@query(
    "content_changes",
    """SELECT 'line items, duplicates removed' AS change,
      (SELECT count(*) FROM (SELECT * FROM lineitem EXCEPT ALL SELECT DISTINCT * FROM lineitem)
        ) > 0 AS changed
    UNION ALL SELECT 'line items, other order', false
    UNION ALL SELECT 'orders, one priority renamed',
      (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') > 0""",
)
def content_changes(spark: SparkSession, folder: str) -> DataFrame:
    lines = testbed.table(spark, folder, "lineitem")
    orders = testbed.table(spark, folder, "orders")
    renamed = orders.replace("1-URGENT", "1-HIGHEST", ["o_orderpriority"])
    cases = {
        "line items, duplicates removed": (lines, lines.distinct()),
        "line items, other order": (lines, lines.repartition("l_partkey")),
        "orders, one priority renamed": (orders, renamed),
    }
    compared = None
    for name, (before, after) in cases.items():
        digest = sinks.content_digest(after)
        same = (F.col("n") == digest.select("n").scalar()) & (
            F.col("digest") == digest.select("digest").scalar()
        )
        row = sinks.content_digest(before).select(F.lit(name).alias("change"), (~same).alias("changed"))
        compared = row if compared is None else compared.unionByName(row)
    return compared


# --- cleaning ------------------------------------------------------------------------------


@query(
    "cleaned_records",
    """SELECT trial AS eudract_number, record_key AS eudract_number_with_country,
      end_date::VARCHAR AS date_of_the_global_end_of_the_trial,
      pip AS trial_is_part_of_a_paediatric_investigation_plan,
      p1 AS trial_human_pharmacology_phase_i, p2 AS trial_therapeutic_exploratory_phase_ii,
      p3 AS trial_therapeutic_confirmatory_phase_iii, p4 AS trial_therapeutic_use_phase_iv,
      bioeq AS trial_bioequivalence_study, not_bioeq AS not_bioequivalence_study,
      sb AS trial_single_blind, not_sb AS not_single_blind, hv AS subject_healthy_volunteers,
      not_hv AS not_healthy_volunteers, rare AS trial_condition_being_studied_is_a_rare_disease,
      not_rare AS not_rare_disease, rare_blank AS rare_disease_blank, results AS trial_results,
      non_eu, full_title, short_title AS abbreviated_title, status AS end_of_trial_status,
      status AS trial_status
    FROM cleaned""",
)
def cleaned_records(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_records(plain_records(spark, folder))
    return with_text_days(cleaned, "date_of_the_global_end_of_the_trial")


@query(
    "document_titles",
    """SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END
      AS title FROM (SELECT doc_id, replace(replace(text, chr(13), ''), chr(10), '') AS t
      FROM documents)""",
)
def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    title = text.display_title(text.without_line_breaks(F.col("text")), F.col("lang"))
    return testbed.table(spark, folder, "documents").select("doc_id", title.alias("title"))


@query("document_slugs", f"SELECT doc_id, {slug('text')} AS slug FROM documents")
def document_slugs(spark: SparkSession, folder: str) -> DataFrame:
    slugged = text.web_slug(F.col("text"))
    return testbed.table(spark, folder, "documents").select("doc_id", slugged.alias("slug"))


@query(
    "page_identifiers",
    r"""SELECT page_id, left(lower(trim(regexp_replace(url, '[\W_]+', '_', 'g'), '_')), 63)
      AS identifier, string_split(url, '/')[-1] AS last_segment,
      page_id::VARCHAR || '-' || string_split(url, '/')[-1] AS record_key FROM pages""",
)
def page_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return testbed.table(spark, folder, "pages").select(
        "page_id",
        text.identifier_slug(F.col("url")).alias("identifier"),
        text.last_path_segment(F.col("url")).alias("last_segment"),
        text.composite_key(F.col("page_id").cast("string"), F.col("url")).alias("record_key"),
    )


# --- studies -------------------------------------------------------------------------------


@query(
    "sponsors_unnested_outer",
    """SELECT trial AS eudract_number, record_key AS eudract_number_with_country,
      name AS name_of_sponsor, status AS status_of_the_sponsor FROM sponsor_rows_outer""",
)
def sponsors_unnested_outer(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.unnest_sponsors(records(spark, folder))


@query(
    "sponsors_unnested_inner",
    """SELECT trial AS eudract_number, record_key AS eudract_number_with_country,
      name AS name_of_sponsor, status AS status_of_the_sponsor FROM sponsor_rows""",
)
def sponsors_unnested_inner(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.unnest_sponsors(records(spark, folder), keep_empty=False)


@query(
    "study_rollup",
    """SELECT trial_id AS eudract_number, * EXCLUDE (trial_id)
      REPLACE (min_end_date::VARCHAR AS min_end_date, max_end_date::VARCHAR AS max_end_date)
    FROM rolled""",
)
def study_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = rollup.roll_up(clean_records(plain_records(spark, folder)))
    return with_text_days(rolled, "min_end_date", "max_end_date")


@query(
    "sponsor_status_of_studies",
    """SELECT trial_id, sponsor_rows::BIGINT AS sponsor_rows, commercial, non_commercial,
      blank_status, sponsor_status FROM sponsor_status""",
)
def sponsor_status_of_studies(spark: SparkSession, folder: str) -> DataFrame:
    return coded(spark, folder).select(
        "trial_id",
        "sponsor_rows",
        "commercial",
        "non_commercial",
        "blank_status",
        "sponsor_status",
    )


@query(
    "study_table",
    """SELECT trial_id, number_of_countries, min_end_date::VARCHAR AS min_end_date,
      max_end_date::VARCHAR AS max_end_date, comp_date, has_results, includes_pip, exempt,
      single_blind, rare_disease, phase, bioequivalence_study, health_volunteers, trial_status,
      any_terminated, all_terminated, results_expected, all_completed_no_comp_date,
      sponsor_status, name_of_sponsor, trial_title, trial_url, comp_date_while_ongoing,
      contains_non_eu, only_non_eu
    FROM study_names JOIN coded USING (trial_id)""",
)
def study_table(spark: SparkSession, folder: str) -> DataFrame:
    return with_text_days(study_rows(spark, folder), "min_end_date", "max_end_date")


@query(
    "study_table_of_live_records",
    f"""SELECT count(DISTINCT r.trial) AS studies, count(*) AS records
    FROM records r JOIN orders ON o_orderkey = r.o
    WHERE date_trunc('month', o_orderdate)
      > (SELECT cutoff FROM ({_cutoff_sql("date_trunc('month', o_orderdate)::DATE", "orders")}))
      ::DATE""",
)
def study_table_of_live_records(spark: SparkSession, folder: str) -> DataFrame:
    warehouse = testbed.protocol_records(spark, folder, scrapes=True)
    table, _ = pipelines.build_study_table(warehouse.select(*STUDY_SCAN_COLUMNS, "meta_updated"))
    studies = table.groupBy("trial_id").agg(F.max("number_of_countries").alias("n"))
    return studies.agg(F.count(F.lit(1)).alias("studies"), F.sum("n").alias("records"))


LABEL_SQL = """CASE overall_status
  WHEN 'reported' THEN 'Reported results' WHEN 'completed-due' THEN 'Not reported'
  WHEN 'ongoing' THEN 'Ongoing' WHEN 'ongoing-reported-early' THEN 'Ongoing, reported early'
  WHEN 'exempt' THEN 'Exempt' WHEN 'exempt-with-results' THEN 'Exempt, with results'
  WHEN 'completed-not-due' THEN 'Completed, report not yet due'
  WHEN 'completed-reported-early' THEN 'Completed, reported early' WHEN 'other' THEN 'Other'
  WHEN 'error-ongoing-has-comp-date' THEN 'Listed as ongoing, but also has a completion date'
    || CASE WHEN has_results = 1 THEN ' and reported results' ELSE '' END
  ELSE CASE overall_status WHEN 'error-completed-no-comp-date' THEN 'Completed, but no date'
    WHEN 'no-trial-status' THEN 'No trial status on register'
    WHEN 'outside-eu' THEN 'Trial is outside EEC'
    WHEN 'partly-outside-eu' THEN 'Trial is partly outside EEC' END
    || CASE WHEN has_results = 1 THEN ', and reported results' ELSE '' END END"""


@query(
    "study_statuses",
    f"""SELECT trial_id, overall_status, CASE
      WHEN overall_status IN ('reported', 'completed-due') THEN 'due-trials'
      WHEN overall_status IN ('error-completed-no-comp-date', 'outside-eu', 'partly-outside-eu',
        'error-ongoing-has-comp-date', 'no-trial-status') THEN 'bad-data'
      ELSE 'not-yet-due' END AS category, {LABEL_SQL} AS status_text,
      CASE WHEN all_terminated = 1 THEN 'Terminated' ELSE '' END AS terminated_tag
    FROM classified""",
)
def study_statuses(spark: SparkSession, folder: str) -> DataFrame:
    return with_labels(coded(spark, folder)).select(
        "trial_id", "overall_status", "category", "status_text", "terminated_tag"
    )


@query(
    "results_rules_compared",
    """SELECT count(*) FILTER (has_results = number_of_countries) AS in_all_countries,
      count(*) FILTER (has_results > 0) AS in_any_country FROM rolled""",
)
def results_rules_compared(spark: SparkSession, folder: str) -> DataFrame:
    rolled = rollup.roll_up(clean_records(plain_records(spark, folder)))
    cutoff = testbed.cutoff(spark, folder)
    counts = [
        rollup.study_codes(rolled, cutoff, rule).agg(F.sum("has_results").alias(name))
        for rule, name in (("all", "in_all_countries"), ("any", "in_any_country"))
    ]
    return counts[0].select("in_all_countries", counts[1].scalar().alias("in_any_country"))


@query(
    "paper_extract",
    """SELECT c.trial_id, c.number_of_countries, c.min_end_date::VARCHAR AS min_end_date,
      c.max_end_date::VARCHAR AS max_end_date, c.comp_date, (r.has_results > 0)::INT AS has_results,
      c.includes_pip, c.rare_disease, c.phase, c.bioequivalence_study, c.health_volunteers,
      c.trial_status, c.any_terminated, c.all_terminated, s.sponsor_status, s.name_of_sponsor
    FROM coded c JOIN rolled r USING (trial_id) LEFT JOIN (
      SELECT trial AS trial_id, max(name) AS name_of_sponsor,
        CASE count(*) WHEN count(*) FILTER (status = 'Non-Commercial') THEN 0
          WHEN count(*) FILTER (status = 'Commercial') THEN 1
          WHEN count(*) FILTER (coalesce(status, '') = '') THEN 3 ELSE 2 END AS sponsor_status
      FROM sponsor_rows GROUP BY trial) s USING (trial_id)""",
)
def paper_extract(spark: SparkSession, folder: str) -> DataFrame:
    return with_text_days(
        paper.paper_extract(records(spark, folder)), "min_end_date", "max_end_date"
    )


# --- sponsors ------------------------------------------------------------------------------


@query(
    "sponsor_matches",
    """SELECT m.trial_id, m.name_of_sponsor_orig, m.raw_slug, s.name_of_sponsor,
      s.normalized_name, s.normalized_parent_name, s.slug, s.parent_slug, s."Proof",
      s."Description" FROM matched m JOIN sheet s USING (raw_slug)""",
)
def sponsor_matches(spark: SparkSession, folder: str) -> DataFrame:
    sheet = sponsors.with_slugs(testbed.sponsor_sheet(spark, folder))
    return sponsors.match_sponsors(study_rows(spark, folder), sheet).select(
        "trial_id",
        "name_of_sponsor_orig",
        "raw_slug",
        "name_of_sponsor",
        "normalized_name",
        "normalized_parent_name",
        "slug",
        "parent_slug",
        "Proof",
        "Description",
    )


def _incomplete_matches(spark: SparkSession, folder: str) -> DataFrame:
    sheet = sponsors.with_slugs(testbed.sponsor_sheet(spark, folder, complete=False))
    return sponsors.match_sponsors(study_rows(spark, folder), sheet)


def _incomplete_names(spark: SparkSession, folder: str) -> DataFrame:
    """The same match by study and raw name only: no study columns, one pass over the records."""
    unnested = rollup.unnest_sponsors(records(spark, folder))
    names = unnested.select(F.col("eudract_number").alias("trial_id"), "name_of_sponsor")
    sheet = sponsors.with_slugs(testbed.sponsor_sheet(spark, folder, complete=False))
    return staged(sponsors.match_sponsors(names.distinct(), sheet))


INCOMPLETE = {
    "reviewed": "SELECT * FROM sheet WHERE NOT (k % 10 = 9 AND name_of_sponsor LIKE '% Ltd.')"
}


@query(
    "unmatched_sponsors",
    """SELECT trial_id, name_of_sponsor_orig FROM matched
    WHERE raw_slug NOT IN (SELECT raw_slug FROM reviewed)""",
    INCOMPLETE,
)
def unmatched_sponsors(spark: SparkSession, folder: str) -> DataFrame:
    rows = sponsors.unmatched(_incomplete_matches(spark, folder))
    return rows.select("trial_id", "name_of_sponsor_orig")


@query(
    "sponsor_worklist",
    """SELECT raw_slug, count(DISTINCT trial_id) AS trials,
      max(name_of_sponsor_orig) AS name_of_sponsor,
      coalesce(max(normalized_name), '') AS normalized_name,
      coalesce(max(normalized_parent_name), '') AS normalized_parent_name,
      coalesce(max("Proof"), '') AS "Proof", coalesce(max("Description"), '') AS "Description",
      coalesce(max("Notes"), '') AS "Notes"
    FROM matched LEFT JOIN reviewed USING (raw_slug) GROUP BY raw_slug""",
    INCOMPLETE,
)
def sponsor_worklist(spark: SparkSession, folder: str) -> DataFrame:
    return quality.sorted_worklist(quality.worklist(_incomplete_names(spark, folder)))


@query("sponsor_worklist_trials", "SELECT DISTINCT raw_slug, trial_id FROM matched")
def sponsor_worklist_trials(spark: SparkSession, folder: str) -> DataFrame:
    return quality.worklist_trials(_incomplete_names(spark, folder))


@query(
    "sponsor_trials",
    """SELECT *, count(*) OVER (PARTITION BY slug) AS total_trials
    FROM sponsor_trials""",
)
def sponsor_trials(spark: SparkSession, folder: str) -> DataFrame:
    pairs = staged(sponsor_pairs(spark, folder))
    rows = pipelines.with_studies(pairs, coded(spark, folder))
    rows = sponsors.with_total_trials(rows, pairs).withColumn(
        "max_end_date", F.coalesce(day_text("max_end_date"), F.lit(""))
    )
    return rows.select(
        "slug",
        "trial_id",
        "raw_slug",
        "parent_slug",
        "normalized_name",
        "normalized_parent_name",
        "name_of_sponsor",
        "name_of_sponsor_orig",
        "Proof",
        "Description",
        "has_results",
        "results_expected",
        "trial_status",
        "overall_status",
        "max_end_date",
        "trial_title",
        "all_terminated",
        "trial_url",
        "total_trials",
    )


def _family_text(name: str) -> Column:
    entry = F.transform(name, lambda s: F.concat(s["slug"], F.lit("="), s["name"]))
    return F.array_join(entry, "; ").alias(name)


@query(
    "sponsor_table",
    """SELECT s.*, coalesce(p.parents, '') AS parents, coalesce(c.children, '') AS children
    FROM sponsors s
    LEFT JOIN (SELECT slug, string_agg(parent_slug || '=' || parent_name, '; ' ORDER BY parent_slug)
      AS parents FROM edges GROUP BY slug) p USING (slug)
    LEFT JOIN (SELECT parent_slug AS slug, string_agg(slug || '=' || sponsor_name, '; '
      ORDER BY slug) AS children FROM edges GROUP BY parent_slug) c USING (slug)""",
)
def published_sponsors(spark: SparkSession, folder: str) -> DataFrame:
    table = sponsors.sponsor_table(sponsor_rows(spark, folder))
    return table.select(
        *[c for c in table.columns if c not in ("parents", "children")],
        _family_text("parents"),
        _family_text("children"),
    )


@query(
    "sponsor_trials_from_study_table",
    "SELECT slug, trial_id, overall_status, name_of_sponsor_orig FROM sponsor_trials",
)
def sponsor_trials_from_study_table(spark: SparkSession, folder: str) -> DataFrame:
    sheet = testbed.sponsor_sheet(spark, folder)
    rows = pipelines.sponsor_trials(study_rows(spark, folder), sheet)
    return rows.select("slug", "trial_id", "overall_status", "name_of_sponsor_orig")


@query("sponsor_edges", "SELECT slug, parent_slug, sponsor_name, parent_name FROM edges")
def sponsor_edges(spark: SparkSession, folder: str) -> DataFrame:
    return sponsors.sponsor_edges(
        sponsors.sponsor_parent_counts(sponsor_rows(spark, folder))
    )


@query(
    "parents_without_studies",
    "SELECT slug, sponsor_name FROM all_counts WHERE total_trials = 0",
)
def parents_without_studies(spark: SparkSession, folder: str) -> DataFrame:
    counts = sponsors.sponsor_parent_counts(sponsor_rows(spark, folder))
    return sponsors.parent_only_sponsors(counts).select("slug", "sponsor_name")


# --- headline ------------------------------------------------------------------------------


# The columns the headline and its sponsor counts are made of.
HEADLINE_COLUMNS = [
    "trial_id",
    "slug",
    "parent_slug",
    "normalized_name",
    "normalized_parent_name",
    "results_expected",
    "has_results",
    "overall_status",
]


def _headline(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(sponsor_rows(spark, folder).select(*HEADLINE_COLUMNS))
    counts = sponsors.sponsor_parent_counts(rows)
    table = sponsors.with_measures(sponsors.sponsor_totals(counts))
    return headline.headline(
        rows, table, testbed.last_scrape(spark, folder), testbed.cutoff(spark, folder)
    )


@query("headline", "SELECT * FROM headline")
def headline_figures(spark: SparkSession, folder: str) -> DataFrame:
    return with_text_days(_headline(spark, folder), "scrape_date", "due_date_cutoff")


@query(
    "headline_history",
    """SELECT o_orderdate::DATE::VARCHAR AS scrape_date, count(*) AS total_trials,
      NULL::DOUBLE AS percent_with_results FROM orders
    WHERE o_orderdate::DATE < (SELECT max(o_orderdate)::DATE FROM orders) GROUP BY 1
    UNION ALL SELECT scrape_date, total_trials, percent_with_results FROM headline""",
)
def headline_history(spark: SparkSession, folder: str) -> DataFrame:
    history = (
        testbed.table(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("scrape_date"))
        .agg(F.count(F.lit(1)).alias("total_trials"))
        .withColumn("percent_with_results", F.lit(None).cast("double"))
    )
    figures = staged(_headline(spark, folder)).select(*history.columns)
    return with_text_days(upsert.upsert_history(history, figures), "scrape_date")


# --- quality -------------------------------------------------------------------------------


@query(
    "duplicate_record_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_record_keys(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_keys(
        testbed.raw_lines(spark, folder), ["l_orderkey", "l_linenumber"]
    )


@query(
    "grandparent_names",
    """SELECT DISTINCT normalized_name AS name FROM changed
    WHERE normalized_name <> parent AND normalized_name IN
      (SELECT parent FROM changed WHERE normalized_name <> parent)""",
    {
        "changed": """SELECT normalized_name, CASE WHEN normalized_name LIKE '% Unit 0'
          THEN 'Independent Holdings' ELSE normalized_parent_name END AS parent FROM sheet"""
    },
)
def grandparent_names(spark: SparkSession, folder: str) -> DataFrame:
    parent = F.when(
        F.col("normalized_name").endswith(" Unit 0"), "Independent Holdings"
    ).otherwise(F.col("normalized_parent_name"))
    sheet = testbed.sponsor_sheet(spark, folder).withColumn("normalized_parent_name", parent)
    return quality.grandparents(sheet)


@query(
    "rule_violations",
    """SELECT 'results_expected_is_0_or_1' AS rule,
      count(*) FILTER (results_expected NOT IN (0, 1)) AS violations FROM coded
    UNION ALL SELECT 'exempt_is_0_or_1', count(*) FILTER (exempt NOT IN (0, 1)) FROM coded
    UNION ALL SELECT 'trial_status_is_0_to_4',
      count(*) FILTER (trial_status NOT BETWEEN 0 AND 4) FROM coded
    UNION ALL SELECT 'date_while_ongoing_needs_status_0_or_2',
      count(*) FILTER (comp_date_while_ongoing <> 0 AND trial_status NOT IN (0, 2)) FROM coded
    UNION ALL SELECT 'no_date_when_completed_needs_status_1',
      count(*) FILTER (all_completed_no_comp_date <> 0 AND trial_status <> 1) FROM coded""",
)
def rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    return quality.violations(coded(spark, folder), quality.study_rules())


@query(
    "total_conflicts",
    """SELECT o_custkey::VARCHAR AS slug, min(n) AS lowest, max(n) AS highest
    FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
    GROUP BY o_custkey HAVING min(n) <> max(n)""",
)
def total_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    orders = testbed.table(spark, folder, "orders")
    rows = orders.groupBy(F.col("o_custkey").cast("string").alias("slug"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("total_trials")
    )
    return quality.total_conflicts(rows)


# --- upserts -------------------------------------------------------------------------------


@query(
    "record_upsert",
    """SELECT coalesce(c.record_key, i.record_key) AS eudract_number_with_country,
      coalesce(md5(c.record_key), md5('new' || i.record_key)) AS meta_id,
      CASE WHEN i.record_key IS NULL THEN c.status ELSE 'Completed' END AS end_of_trial_status,
      CASE WHEN i.record_key IS NULL THEN c.end_date END::VARCHAR
        AS date_of_the_global_end_of_the_trial,
      CASE WHEN c.record_key IS NULL THEN '2002-01-01' ELSE '2001-01-01' END AS meta_created,
      CASE WHEN i.record_key IS NULL THEN '2001-01-01' ELSE '2002-01-01' END AS meta_updated
    FROM (SELECT * FROM records WHERE o % 10 <> 0) c
    FULL JOIN (SELECT * FROM records WHERE o % 4 = 0 OR o % 10 = 0) i ON c.record_key = i.record_key""",
)
def record_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = plain_records(spark, folder)
    key = F.col("eudract_number_with_country")
    number = F.col("eudract_number").cast("long")
    then = F.lit("2001-01-01").cast("timestamp")
    now = F.lit("2002-01-01").cast("timestamp")
    current = rows.where(number % 10 != 0).select(
        key,
        F.md5(key).alias("meta_id"),
        "end_of_trial_status",
        "date_of_the_global_end_of_the_trial",
        then.alias("meta_created"),
        then.alias("meta_updated"),
    )
    # The new rows no longer have an end date; each comes twice, and the second counts.
    versions = F.explode(F.array(F.lit("Ongoing"), F.lit("Completed")))
    incoming = (
        rows.where((number % 4 == 0) | (number % 10 == 0))
        .select(
            key,
            F.md5(F.concat(F.lit("new"), key)).alias("meta_id"),
            versions.alias("end_of_trial_status"),
        )
        .withColumn("version", (F.col("end_of_trial_status") == "Completed").cast("int"))
    )
    path = new_path(spark, "records")
    record_table.create_table(current, path, buckets=16)
    record_table.upsert_into(spark, path, incoming, now, buckets=16, order=["version"])
    return with_text_days(
        record_table.read_table(spark, path).drop(record_table.BUCKET),
        "date_of_the_global_end_of_the_trial",
        "meta_created",
        "meta_updated",
    )


@query(
    "current_record_versions",
    """SELECT user_id, arg_min(event_id, (ts, event_id)) AS meta_id,
      min(ts)::DATE::VARCHAR AS meta_created,
      arg_max(event_type, (ts, event_id)) AS event_type,
      arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id""",
)
def current_record_versions(spark: SparkSession, folder: str) -> DataFrame:
    versions = testbed.table(spark, folder, "events").select(
        "user_id",
        "ts",
        "event_id",
        F.col("event_id").alias("meta_id"),
        F.col("ts").alias("meta_created"),
        "event_type",
        "value",
    )
    current = upsert.current_records(versions, ["ts", "event_id"], "user_id")
    return with_text_days(current, "meta_created").drop("ts", "event_id")


@query(
    "streamed_records",
    """SELECT user_id, arg_min(event_id, (ts, event_id)) AS meta_id,
      arg_max(event_type, (ts, event_id)) AS event_type,
      arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id""",
)
def streamed_records(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of record versions, upserted batch by batch."""
    run = new_path(spark, "stream")
    # A stream reads folders or patterns; this one fits the one file of events.
    files = f"{folder}/event[s].parquet"
    fields = testbed.table(spark, folder, "events").schema
    order = ["ts", "event_id"]
    arriving = (
        spark.readStream.schema(fields)
        .parquet(files)
        .select("user_id", "ts", "event_id", F.col("event_id").alias("meta_id"), "event_type", "value")
    )
    stream = record_stream.start_record_stream(
        arriving, f"{run}/versions", f"{run}/checkpoint", order, "user_id"
    )
    stream.awaitTermination()
    current = record_stream.read_current(
        spark, f"{run}/versions", arriving.schema, order, "user_id"
    )
    return current.select("user_id", "meta_id", "event_type", "value")


# --- pages ---------------------------------------------------------------------------------


@query(
    "page_links",
    r"""SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link
    FROM (SELECT url, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href
          FROM pages)
    WHERE regexp_matches(href, '/[A-Za-z]+') AND NOT regexp_matches(href, '\.$')""",
)
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_links(
        testbed.table(spark, folder, "pages"), allow=r"[a-z]/[A-Za-z]+", deny=r"\.$"
    )


def _list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One search-result page per order: its record, its results and the next page."""
    key = F.col("o_orderkey").cast("string")
    base = F.lit(f"{testbed.PAGE_HOST}/ctr-search/search?query=")
    html = F.concat(
        F.lit("<p><a href='/ctr-search/trial/"), key, F.lit("/DE'>record</a>"),
        F.lit('<a class="x" href="trial/'), key, F.lit('/GB">record</a>'),
        F.lit('<a href="./trial/../trial/'), key, F.lit('/GB">again</a>'),
        F.lit('<a href="/ctr-search/trial/'), key, F.lit('/results">results</a>'),
        F.lit('<a href="/ctr-search/search?query=&amp;page='), key,
        F.lit('" accesskey="n">next</a><a href="/x?page=1" accesskey="p">previous</a></p>'),
    )
    return testbed.table(spark, folder, "orders").select(
        F.concat(base, key).alias("url"), html.alias("html")
    )


@query(
    "record_links",
    f"""SELECT '{testbed.PAGE_HOST}/ctr-search/search?query=' || o_orderkey::VARCHAR AS url,
      '{testbed.PAGE_HOST}/ctr-search/trial/' || o_orderkey::VARCHAR || '/'
        || unnest(['DE', 'GB']) AS link FROM orders""",
)
def record_links(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_links(_list_pages(spark, folder))


@query(
    "next_page_links",
    f"""SELECT '{testbed.PAGE_HOST}/ctr-search/search?query=' || o_orderkey::VARCHAR AS url,
      '{testbed.PAGE_HOST}/ctr-search/search?query=&page=' || o_orderkey::VARCHAR AS link
    FROM orders""",
)
def next_page_links(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_links(
        _list_pages(spark, folder), extract.PAGE_LINK, deny=None, accesskey="n"
    )


@query(
    "extracted_records",
    f"""SELECT trial AS eudract_number, record_key AS eudract_number_with_country,
      '{testbed.PAGE_HOST}/ctr-search/trial/' || trial || '/results' AS trial_results_url,
      status AS end_of_trial_status, status AS trial_status, results AS trial_results,
      end_date::VARCHAR AS date_of_the_global_end_of_the_trial,
      pip AS trial_is_part_of_a_paediatric_investigation_plan,
      p1 AS trial_human_pharmacology_phase_i, p2 AS trial_therapeutic_exploratory_phase_ii,
      p3 AS trial_therapeutic_confirmatory_phase_iii, p4 AS trial_therapeutic_use_phase_iv,
      bioeq AS trial_bioequivalence_study, sb AS trial_single_blind,
      hv AS subject_healthy_volunteers, rare AS trial_condition_being_studied_is_a_rare_disease,
      trim(full_title) AS full_title_of_the_trial,
      short_title AS name_or_abbreviated_title_of_the_trial_where_available,
      length(trial)::INT AS subject_childs, NULL::BOOLEAN AS trial_other FROM records""",
)
def extracted_records(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.extract_records(testbed.record_pages(spark, folder))
    wanted = [c for c in STUDY_SCAN_COLUMNS if c != "sponsors"]
    rows = found.select(*wanted, "trial_results_url", "subject_childs", "trial_other")
    return with_text_days(rows, "date_of_the_global_end_of_the_trial")


@query(
    "extracted_sponsors",
    """SELECT record_key AS eudract_number_with_country, name AS name_of_sponsor,
      status AS status_of_the_sponsor FROM sponsor_rows""",
)
def extracted_sponsors(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.extract_records(testbed.record_pages(spark, folder))
    return rollup.unnest_sponsors(found, keep_empty=False).drop("eudract_number")


@query(
    "unknown_page_fields",
    "SELECT 'trial_not_in_the_form' AS field, count(*) AS pages FROM records",
)
def unknown_page_fields(spark: SparkSession, folder: str) -> DataFrame:
    pages = extract.page_cells(testbed.record_pages(spark, folder))
    return extract.unknown_fields(extract.assemble(pages))


# --- cohorts -------------------------------------------------------------------------------

CATEGORIES = [v for v in cohort.TABLE_VARIABLES if v != "results"]


def _tables_sql(variables: list[str], table: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS variable, coalesce({v}, -1)::INT AS value, {columns} "
        f"FROM {table} GROUP BY {v}"
        for v in variables
    )


def _missing_as_code(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.coalesce("value", F.lit(-1)))


@query(
    "cohort_frequencies",
    _tables_sql(cohort.TABLE_VARIABLES, "cohort", "count(*) AS n"),
)
def cohort_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder)
    return _missing_as_code(cohort.frequencies(rows, cohort.TABLE_VARIABLES))


@query(
    "due_cohort_frequencies",
    _tables_sql(cohort.TABLE_VARIABLES, "due_cohort", "count(*) AS n"),
)
def due_cohort_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    rows = due_rows(spark, folder)
    return _missing_as_code(cohort.frequencies(rows, cohort.TABLE_VARIABLES))


CROSS_SQL = """count(*) FILTER (results = 0) AS n_0, count(*) FILTER (results = 1) AS n_1,
  count(*) FILTER (results IS NULL) AS n_missing, count(*) AS n"""


@query("cohort_crosstabs", _tables_sql(CATEGORIES, "due_cohort", CROSS_SQL))
def cohort_crosstabs(spark: SparkSession, folder: str) -> DataFrame:
    return _missing_as_code(cohort.crosstabs(due_rows(spark, folder), CATEGORIES))


@query(
    "single_country_crosstabs",
    _tables_sql(CATEGORIES, "(SELECT * FROM due_cohort WHERE country_count = 1)", CROSS_SQL),
)
def single_country_crosstabs(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort.single_country(due_rows(spark, folder))
    return _missing_as_code(cohort.crosstabs(rows, CATEGORIES))


PROPORTION_VARIABLES = [*CATEGORIES, "decile", "everything"]

_SHARES = f"""SELECT variable, value, n_1::DOUBLE / nullif(n_0 + n_1, 0) AS p, (n_0 + n_1)::DOUBLE AS n
  FROM ({_tables_sql(PROPORTION_VARIABLES, "(SELECT *, 0 AS everything FROM due_cohort)", CROSS_SQL)})"""


def _limit_sql(sign: str) -> str:
    """End of the interval on the logit scale; a share of 0 or 1 has none."""
    half = f"{cohort.t_95_sql('n - 1')} * sqrt(p * (1 - p) / (n - 1)) / (p * (1 - p))"
    return f"""CASE WHEN p > 0 AND p < 1 AND n > 1
      THEN round(1 / (1 + exp(-(ln(p / (1 - p)) {sign} {half}))), 6) END"""


@query(
    "cohort_proportions",
    f"""SELECT variable, value, round(p, 6) AS proportion,
      round(CASE WHEN n > 1 THEN sqrt(p * (1 - p) / (n - 1)) END, 6) AS std_err,
      {_limit_sql("-")} AS ci_low, {_limit_sql("+")} AS ci_high
    FROM ({_SHARES})""",
)
def cohort_proportions(spark: SparkSession, folder: str) -> DataFrame:
    rows = due_rows(spark, folder).withColumn("everything", F.lit(0))
    tables = cohort.proportions(cohort.crosstabs(rows, PROPORTION_VARIABLES))
    return _missing_as_code(tables).select(
        "variable",
        "value",
        *[F.round(c, 6).alias(c) for c in ("proportion", "std_err", "ci_low", "ci_high")],
    )


@query(
    "cohort_attrition",
    """SELECT 0 AS step, 'all' AS label, count(*) AS n FROM cohort
    UNION ALL SELECT 1, 'all countries completed', count(*) FILTER (trial_status = 1) FROM cohort
    UNION ALL SELECT 2, 'with a completion date',
      count(*) FILTER (trial_status = 1 AND max_end_date IS NOT NULL) FROM cohort
    UNION ALL SELECT 3, 'completed by the last day',
      count(*) FILTER (trial_status = 1 AND max_end_date <= DATE '2000-06-30') FROM cohort
    UNION ALL SELECT 4, 'not an early-phase study of adults', count(*) FROM due_cohort""",
)
def cohort_attrition(spark: SparkSession, folder: str) -> DataFrame:
    series = {"due": cohort.due_steps(LAST_DAY)}
    return cohort.attrition(cohort_rows(spark, folder), series).drop("series")


_DONE, _LATE = "trial_status = 1", "NOT (phase = 1 AND includes_pip = 0)"


@query(
    "completeness_counts",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{series}' AS series, {i} AS step, count(*) FILTER ({c}) AS n FROM cohort"
        for series, conditions in {
            "completed": ["true", _DONE, f"{_DONE} AND max_end_date IS NOT NULL"],
            "completed and dated": [
                "true",
                _LATE,
                f"{_LATE} AND {_DONE}",
                f"{_LATE} AND {_DONE} AND max_end_date IS NOT NULL",
                f"{_LATE} AND {_DONE} AND max_end_date <= DATE '2000-06-30'",
            ],
            "completed, no date": [
                "true",
                _LATE,
                f"{_LATE} AND {_DONE}",
                f"{_LATE} AND {_DONE} AND max_end_date IS NULL",
            ],
            "partly completed, dated": [
                "true",
                "trial_status = 2",
                "trial_status = 2 AND max_end_date IS NOT NULL",
            ],
        }.items()
        for i, c in enumerate(conditions)
    )
    + ")",
)
def completeness_counts(spark: SparkSession, folder: str) -> DataFrame:
    series = cohort.completeness_steps(LAST_DAY)
    return cohort.attrition(cohort_rows(spark, folder), series).drop("label")


@query(
    "sponsor_size_by_quartile",
    """SELECT 'quartile' AS bins, quartile AS bin, count(*) AS n,
      round(avg(sponsor_trial_count), 6) AS mean, round(stddev_samp(sponsor_trial_count), 6) AS sd,
      min(sponsor_trial_count) AS min, max(sponsor_trial_count) AS max
    FROM cohort GROUP BY quartile
    UNION ALL SELECT 'decile', decile, count(*), round(avg(sponsor_trial_count), 6),
      round(stddev_samp(sponsor_trial_count), 6), min(sponsor_trial_count),
      max(sponsor_trial_count) FROM cohort GROUP BY decile""",
)
def sponsor_size_by_quartile(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder)
    both = None
    for bins in ("quartile", "decile"):
        one = cohort.summary_by(rows, bins, "sponsor_trial_count").select(
            F.lit(bins).alias("bins"),
            F.col(bins).alias("bin"),
            "n",
            F.round("mean", 6).alias("mean"),
            F.round("sd", 6).alias("sd"),
            "min",
            "max",
        )
        both = one if both is None else both.unionByName(one)
    return both


@query(
    "price_bins",
    """SELECT bin, count(*) AS n, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
    FROM (SELECT l_extendedprice,
            1 + (SELECT count(*) FROM cuts WHERE cut < l_extendedprice)::INT AS bin
          FROM lineitem) GROUP BY bin""",
    {
        "ranks": """SELECT l_extendedprice AS v,
          row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS total
          FROM lineitem""",
        "cuts": cut_points("ranks", 10),
    },
)
def price_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = quantile.quantile_bin(
        testbed.raw_lines(spark, folder), "l_extendedprice", 10, "bin"
    )
    return rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_extendedprice").alias("lowest"),
        F.max("l_extendedprice").alias("highest"),
    )


@query(
    "end_date_differences",
    """SELECT discrepant_date, n, round(mean, 6) AS mean, round(sd, 4) AS sd,
      round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, min, max,
      p1, p5, p10, p25, p50, p75, p90, p95, p99
    FROM (SELECT discrepant_date, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd,
        avg((d - m) ** 3) / nullif(avg((d - m) ** 2), 0) ** 1.5 AS skewness,
        avg((d - m) ** 4) / nullif(avg((d - m) ** 2), 0) ** 2 AS kurtosis,
        min(d) AS min, max(d) AS max
      FROM diffs JOIN (SELECT discrepant_date, avg(d) AS m FROM diffs GROUP BY 1)
        USING (discrepant_date) GROUP BY discrepant_date)
    JOIN points USING (discrepant_date)""",
    {
        "diffs": """SELECT (max_end_date - min_end_date)::INT AS d,
          (max_end_date > min_end_date)::INT AS discrepant_date FROM cohort
          WHERE max_end_date IS NOT NULL""",
        "diff_ranks": """SELECT discrepant_date, d AS v,
          row_number() OVER (PARTITION BY discrepant_date ORDER BY d) AS r,
          count(*) OVER (PARTITION BY discrepant_date) AS total FROM diffs""",
        "points": "SELECT discrepant_date, "
        + ", ".join(
            f"""CASE WHEN any_value(total) * {p} % 100 = 0
            THEN (max(v) FILTER (r = total * {p} // 100)
                + max(v) FILTER (r = total * {p} // 100 + 1)) / 2
            ELSE max(v) FILTER (r = total * {p} // 100 + 1) END::DOUBLE AS p{p}"""
            for p in quantile.DETAIL_PERCENTILES
        )
        + " FROM diff_ranks GROUP BY discrepant_date",
    },
)
def end_date_differences(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort.date_discrepancy(cohort_rows(spark, folder)).where("max_end_date IS NOT NULL")
    found = quantile.detailed_summary(rows, "datedifference", ["discrepant_date"])
    return found.select(
        "discrepant_date",
        "n",
        F.round("mean", 6).alias("mean"),
        F.round("sd", 4).alias("sd"),
        F.round("skewness", 6).alias("skewness"),
        F.round("kurtosis", 6).alias("kurtosis"),
        "min",
        "max",
        *[f"p{p}" for p in quantile.DETAIL_PERCENTILES],
    )


@query(
    "one_study_per_sponsor",
    """SELECT normalized_name, trial_id, results FROM due_cohort
    QUALIFY row_number() OVER (PARTITION BY normalized_name
      ORDER BY md5('1:' || trial_id), trial_id) = 1""",
)
def one_study_per_sponsor(spark: SparkSession, folder: str) -> DataFrame:
    rows = due_rows(spark, folder).select("normalized_name", "trial_id", "results")
    return cohort.one_per_group(rows, "normalized_name", "trial_id")


def _labels_sql() -> str:
    """The labels as SQL, from the fixed lists; a code outside a list has none."""
    return ", ".join(
        f"CASE {name} "
        + " ".join(f"WHEN {code} THEN '{words}'" for code, words in known.items())
        + f" END AS {name}_label"
        for name, known in labels.COHORT_LABELS.items()
    )


@query("cohort_labels", f"SELECT trial_id, {_labels_sql()} FROM cohort")
def cohort_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder)
    for variable in labels.COHORT_LABELS:
        rows = cohort.with_labels(rows, variable)
    return rows.select("trial_id", *[f"{v}_label" for v in labels.COHORT_LABELS])


# --- models --------------------------------------------------------------------------------


def _model_rows(due: DataFrame) -> DataFrame:
    return cohort.keep_unless(due, F.col("completionyear") < FIRST_YEAR)


def _rounded(rows: DataFrame) -> DataFrame:
    # Odds ratios of small tables are short fractions: one digit more keeps them off the
    # half-way points of rounding.
    digits = {"odds_ratio": 4, "coefficient": 3, "std_err": 3, "z": 3, "p_value": 3}
    return rows.withColumns({c: F.round(c, d) for c, d in digits.items()})


MODEL_ROWS = {"model_rows": f"SELECT * FROM due_cohort WHERE completionyear >= {FIRST_YEAR}"}


def _closed_form_sql(factor: logistic.Factor) -> str:
    name = factor.name
    base = f"{factor.base}" if factor.base is not None else f"(SELECT min({name}) FROM model_rows)"
    odds = "(nullif(l.a, 0)::DOUBLE / nullif(l.b, 0)) / (nullif(r.a, 0)::DOUBLE / nullif(r.b, 0))"
    errors = " + ".join(f"1.0 / nullif({c}, 0)" for c in ("l.a", "l.b", "r.a", "r.b"))
    return f"""
SELECT '{name}' AS model, '{name}=' || l.v::VARCHAR AS term, l.a + l.b AS n,
  round({odds}, 4) AS odds_ratio, round(ln({odds}), 3) AS coefficient,
  round(sqrt({errors}), 3) AS std_err
FROM (SELECT {name} AS v, count(*) FILTER (results = 1) AS a, count(*) FILTER (results = 0) AS b
      FROM model_rows GROUP BY {name}) l
JOIN (SELECT count(*) FILTER (results = 1) AS a, count(*) FILTER (results = 0) AS b
      FROM model_rows WHERE {name} = {base}) r ON l.v <> {base}"""


@query(
    "single_factor_models",
    " UNION ALL ".join(_closed_form_sql(f) for f in logistic.FACTORS),
    MODEL_ROWS,
)
def single_factor_models(spark: SparkSession, folder: str) -> DataFrame:
    rows = _model_rows(due_rows(spark, folder))
    fitted = logistic.single_factor_models(rows, logistic.FACTORS)
    digits = {"odds_ratio": 4, "coefficient": 3, "std_err": 3}
    return fitted.withColumns({c: F.round(c, d) for c, d in digits.items()}).drop("z")


_OTHERS = [f for f in logistic.FACTORS if f.name != "quartile"]
# The first year of the test tables stands for the register's base year.
MODELS = {
    "year_model": [logistic.CONTINUOUS_YEAR],
    "full_model": [logistic.CONTINUOUS_YEAR, *logistic.FACTORS],
    "sponsor_size_model": [logistic.CONTINUOUS_YEAR, "sponsor_trial_count", *_OTHERS],
    "year_dummies_model": [logistic.Factor("completionyear", FIRST_YEAR), *logistic.FACTORS],
    "sampled_sponsor_model": [logistic.CONTINUOUS_YEAR, *logistic.FACTORS],
}


def _rows_of_model(due: DataFrame, name: str) -> DataFrame:
    if name == "sampled_sponsor_model":
        return cohort.one_per_group(due, "normalized_name", "trial_id")
    return _model_rows(due)


def _fitted(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = _rows_of_model(due_rows(spark, folder), name)
    return _rounded(logistic.odds_ratios(spark, rows, MODELS[name]))


@query("year_model")
def year_model(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "year_model")


@query("full_model")
def full_model(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "full_model")


@query("sponsor_size_model")
def sponsor_size_model(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "sponsor_size_model")


@query("year_dummies_model")
def year_dummies_model(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "year_dummies_model")


@query("sampled_sponsor_model")
def sampled_sponsor_model(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "sampled_sponsor_model")


def _known_rows_sql(name: str) -> str:
    source = "model_rows"
    if name == "sampled_sponsor_model":
        source = """(SELECT * FROM due_cohort QUALIFY row_number() OVER (
          PARTITION BY normalized_name ORDER BY md5('1:' || trial_id), trial_id) = 1)"""
    known = " AND ".join(f"{t} IS NOT NULL" for t in ["results", *logistic.term_names(MODELS[name])])
    return f"SELECT '{name}' AS model, count(*) AS n, 0.0 AS gap FROM {source} WHERE {known}"


@query("model_fits", " UNION ALL ".join(map(_known_rows_sql, MODELS)), MODEL_ROWS)
def model_fits(spark: SparkSession, folder: str) -> DataFrame:
    """Where a model has converged, observed and fitted totals agree for every term.

    (model, rows used or left out for perfect levels, largest difference of the totals).
    """
    found, due = None, due_rows(spark, folder)
    for name, terms in MODELS.items():
        totals = logistic.fit_totals(spark, _rows_of_model(due, name), terms)
        one = totals.agg(
            F.lit(name).alias("model"),
            F.max(F.col("used") + F.col("dropped")).cast("long").alias("n"),
            # plus 0.0: no negative zero
            (F.round(F.max(F.abs(F.col("observed") - F.col("fitted"))), 3) + 0.0).alias("gap"),
        )
        found = one if found is None else found.unionByName(one)
    return found


# --- browsing ------------------------------------------------------------------------------


@query(
    "sponsors_by_due",
    "SELECT slug, sponsor_name, total_due, total_trials FROM sponsors WHERE total_trials > 0",
)
def sponsors_by_due(spark: SparkSession, folder: str) -> DataFrame:
    ranked = browse.sponsors_by_due(browse.having_trials(sponsor_table(spark, folder)))
    return ranked.select("slug", "sponsor_name", "total_due", "total_trials")


@query(
    "major_sponsors",
    "SELECT slug, sponsor_name, total_due, total_trials FROM sponsors WHERE major = 1",
)
def major_sponsors(spark: SparkSession, folder: str) -> DataFrame:
    ranked = browse.major_sponsors(sponsor_table(spark, folder))
    return ranked.select("slug", "sponsor_name", "total_due", "total_trials")


@query(
    "sponsor_page",
    """SELECT slug, sponsor_name, percent_reported FROM sponsors
    ORDER BY percent_reported DESC NULLS LAST, slug OFFSET 10 LIMIT 10""",
)
def sponsor_page(spark: SparkSession, folder: str) -> DataFrame:
    ordered = browse.sort_rows(
        sponsor_table(spark, folder), [("percent_reported", "desc")], ["slug"]
    )
    return browse.page(ordered, 1, 10).select("slug", "sponsor_name", "percent_reported")


@query(
    "sponsor_page_lowest_first",
    """SELECT slug, sponsor_name, percent_reported FROM sponsors
    ORDER BY percent_reported ASC NULLS FIRST, slug LIMIT 10""",
)
def sponsor_page_lowest_first(spark: SparkSession, folder: str) -> DataFrame:
    ordered = browse.sort_rows(
        sponsor_table(spark, folder), [("percent_reported", "asc")], ["slug"]
    )
    return browse.page(ordered, 0, 10).select("slug", "sponsor_name", "percent_reported")


@query(
    "sponsor_search",
    """SELECT slug, sponsor_name FROM sponsors
    WHERE contains(lower(slug || '  ' || sponsor_name), 'unit 1')
      AND contains(lower(slug || '  ' || sponsor_name), 'nation_2')""",
)
def sponsor_search(spark: SparkSession, folder: str) -> DataFrame:
    return browse.search(
        sponsor_table(spark, folder).select("slug", "sponsor_name"), 'NATION_2 "unit 1"'
    )


@query(
    "document_search_count",
    """SELECT count(*) AS matches FROM documents WHERE
      contains(lower(text || '  ' || lang || '  ' || source), 'the')
      AND contains(lower(text || '  ' || lang || '  ' || source), 'src1')""",
)
def document_search_count(spark: SparkSession, folder: str) -> DataFrame:
    documents = testbed.table(spark, folder, "documents")
    found = browse.search(documents, "SRC1 the", ["text", "lang", "source"])
    return found.agg(F.count(F.lit(1)).alias("matches"))


@query(
    "trials_of_one_sponsor",
    """SELECT trial_id, overall_status, max_end_date FROM sponsor_trials
    WHERE slug = 'nation_9-unit-0'""",
)
def trials_of_one_sponsor(spark: SparkSession, folder: str) -> DataFrame:
    """The trials as published, in buckets of the slug; the lookup opens one of them."""
    path, shown = new_path(spark, "trials"), ["slug", "trial_id", "overall_status", "max_end_date"]
    record_table.create_table(sponsor_rows(spark, folder).select(*shown), path, 64, "slug")
    rows = record_table.lookup(spark, path, "nation_9-unit-0", 64, "slug")
    return rows.select(
        "trial_id",
        "overall_status",
        F.coalesce(day_text("max_end_date"), F.lit("")).alias("max_end_date"),
    )


@query(
    "sponsor_percent_texts",
    """SELECT slug, coalesce(percent_reported::VARCHAR || '%', '-') AS reported,
      coalesce(percent_bad_data::VARCHAR || '%', '-') AS bad_data FROM sponsors""",
)
def sponsor_percent_texts(spark: SparkSession, folder: str) -> DataFrame:
    return sponsor_table(spark, folder).select(
        "slug",
        numbers.percent_text(F.col("percent_reported")).alias("reported"),
        numbers.percent_text(F.col("percent_bad_data")).alias("bad_data"),
    )
