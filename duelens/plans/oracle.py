"""Plain SQL with the same results as the registered queries, for checking them."""

from __future__ import annotations

import re


def slug(expr: str) -> str:
    """The web slug of accented Latin text."""
    kept = f"regexp_replace(strip_accents({expr}), '[^\\w\\s-]', '', 'g')"
    trimmed = f"regexp_replace({kept}, '^\\s+|\\s+$', '', 'g')"
    return f"regexp_replace(lower({trimmed}), '[-\\s]+', '-', 'g')"


def percent(part: str, whole: str) -> str:
    return f"round_even(({part})::DOUBLE / nullif({whole}, 0) * 100, 1)"


CUTOFF = (
    "(SELECT (max(o_orderdate)::DATE - INTERVAL 1 YEAR - INTERVAL 28 DAY)::DATE FROM orders)"
)

STATUS = """CASE
  WHEN o % 12 <= 3 AND l_returnflag = 'R' AND q > 40 THEN 'Prematurely Ended'
  WHEN o % 12 <= 3 THEN 'Completed'
  WHEN o % 12 = 4 THEN 'Prematurely Ended'
  WHEN o % 12 = 5 THEN CASE WHEN l_returnflag = 'R' THEN 'Restarted' ELSE 'Ongoing' END
  WHEN o % 12 = 6 THEN CASE WHEN l_returnflag = 'A' THEN 'Completed' ELSE 'Ongoing' END
  WHEN o % 12 = 8 THEN CASE WHEN l_linestatus = 'O' THEN 'Temporarily Halted'
                            ELSE 'Suspended by CA' END
  WHEN o % 12 = 9 THEN CASE WHEN l_linestatus = 'O' THEN 'Not Authorised'
                            ELSE 'Prohibited by CA' END
  WHEN o % 12 = 10 THEN 'Withdrawn'
  WHEN o % 12 = 11 AND l_returnflag = 'A' THEN 'Completed'
  WHEN o % 12 = 11 AND l_returnflag = 'R' THEN 'Withdrawn' END"""

VIEWS = {
    "lines": """
SELECT *, l_orderkey AS o, l_linenumber AS n, l_quantity::INT AS q,
  round(l_discount * 100)::INT AS d, round(l_tax * 100)::INT AS t
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
  l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC,
  l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
    "records": f"""
SELECT o::VARCHAR AS trial,
  o::VARCHAR || '-' || CASE WHEN n = 7 AND t >= 4 THEN '3rd' ELSE n::VARCHAR END AS record_key,
  CASE WHEN NOT (o % 5 = 0 OR (o % 5 = 1 AND l_linestatus = 'O')) AND o % 12 <> 7
       THEN l_shipdate::DATE END AS end_date,
  CASE WHEN o % 7 = 0 THEN q > 25 WHEN o % 7 <> 1 THEN false END AS pip,
  {STATUS} AS status,
  CASE WHEN o % 9 = 0 THEN true WHEN o % 9 = 1 THEN q > 10 WHEN q < 50 THEN false END AS p1,
  o % 9 IN (2, 3) AS p2,
  o % 9 IN (4, 5, 6) AS p3,
  o % 9 = 7 AND q > 5 AS p4,
  CASE WHEN o % 11 = 0 THEN true WHEN o % 11 <= 6 THEN false
       WHEN o % 11 > 7 THEN d >= 5 END AS bioeq,
  CASE WHEN o % 6 = 0 THEN true WHEN o % 6 < 4 THEN false WHEN o % 6 > 4 THEN d >= 5 END AS hv,
  CASE WHEN o % 8 = 0 THEN 'Yes' WHEN o % 8 <= 3 THEN 'No'
       WHEN o % 8 = 4 THEN 'Information not present in EudraCT'
       WHEN o % 8 > 5 THEN CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'N' THEN 'No'
            ELSE 'Information not present in EudraCT' END END AS rare,
  CASE WHEN o % 13 < 2 THEN true WHEN o % 13 < 8 THEN false WHEN o % 13 > 8 THEN t >= 4 END AS sb,
  CASE WHEN o % 23 = 0 THEN 'nan' WHEN d > 0 THEN 'Study ' || o::VARCHAR || chr(13) || chr(10) || ' of '
       || repeat('long-term follow-up ', q // 4) END AS full_title,
  CASE WHEN t > 0 THEN 'S-' || o::VARCHAR || '/' || n::VARCHAR END AS short_title,
  CASE WHEN o % 17 < 6 OR (o % 17 < 12 AND q > 20) THEN 'View results' END AS results,
  o, n, q, d, t, l_suppkey
FROM lines""",
    "sponsor_rows": """
SELECT r.trial, r.record_key,
  CASE n % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN replace(s_name, 'u', 'ü')
             ELSE s_name END AS name,
  CASE WHEN s_acctbal >= 4500 THEN 'Non-Commercial' WHEN s_acctbal >= 0 THEN 'Commercial' END
    AS status
FROM records r JOIN supplier ON s_suppkey = l_suppkey
WHERE d <> 10 AND NOT (d = 0 AND t = 0)
UNION ALL
SELECT r.trial, r.record_key, s_name || ' Ltd.', NULL
FROM records r JOIN supplier ON s_suppkey = l_suppkey
WHERE n = 1 AND d >= 5 AND d <> 10""",
    "sponsor_rows_outer": """
SELECT * FROM sponsor_rows
UNION ALL
SELECT trial, record_key, NULL, NULL FROM records WHERE d = 10 OR (d = 0 AND t = 0)""",
    "cleaned": """
SELECT trial, record_key, end_date, status,
  coalesce(pip, false)::INT AS pip, coalesce(p1, false)::INT AS p1,
  coalesce(p2, false)::INT AS p2, coalesce(p3, false)::INT AS p3,
  coalesce(p4, false)::INT AS p4, coalesce(bioeq, false)::INT AS bioeq,
  coalesce(NOT bioeq, false)::INT AS not_bioeq, coalesce(sb, false)::INT AS sb,
  coalesce(NOT sb, false)::INT AS not_sb, coalesce(hv, false)::INT AS hv,
  coalesce(NOT hv, false)::INT AS not_hv, coalesce(rare = 'Yes', false)::INT AS rare,
  coalesce(rare = 'No', false)::INT AS not_rare,
  coalesce(rare = 'Information not present in EudraCT', false)::INT AS rare_blank,
  (results IS NOT NULL)::INT AS results, (record_key LIKE '%-3rd%')::INT AS non_eu,
  full_title, short_title
FROM records""",
    "rolled": """
SELECT trial AS trial_id, count(*) AS number_of_countries, min(end_date) AS min_end_date,
  max(end_date) AS max_end_date, count(end_date) AS comp_date,
  sum(results)::BIGINT AS has_results, sum(pip)::BIGINT AS includes_pip,
  sum(sb)::BIGINT AS single_blind, sum(not_sb)::BIGINT AS not_single_blind,
  sum(rare)::BIGINT AS rare_disease, sum(not_rare)::BIGINT AS not_rare_disease,
  sum(rare_blank)::BIGINT AS rare_disease_blank,
  count(*) FILTER (status = 'Completed') AS completed,
  count(*) FILTER (status IN ('Ongoing', 'Restarted')) AS ongoing,
  count(*) FILTER (status = 'Prematurely Ended') AS terminated,
  count(*) FILTER (status IN ('Temporarily Halted', 'Suspended by CA')) AS suspended,
  count(*) FILTER (status IN ('Not Authorised', 'Prohibited by CA')) AS other_status,
  count(*) FILTER (status IS NULL) AS no_status,
  sum(p1)::BIGINT AS phase_1, sum(p2)::BIGINT AS phase_2, sum(p3)::BIGINT AS phase_3,
  sum(p4)::BIGINT AS phase_4, sum(bioeq)::BIGINT AS bioequivalence,
  sum(not_bioeq)::BIGINT AS not_bioequivalence, sum(hv)::BIGINT AS healthy_volunteers,
  sum(not_hv)::BIGINT AS not_healthy_volunteers, min(full_title) AS full_title,
  max(short_title) AS abbreviated_title, sum(non_eu)::BIGINT AS non_eu
FROM cleaned GROUP BY trial""",
    "sponsor_status": """
SELECT trial AS trial_id, count(*) AS sponsor_rows,
  count(*) FILTER (status = 'Commercial') AS commercial,
  count(*) FILTER (status = 'Non-Commercial') AS non_commercial,
  count(*) FILTER (status IS NULL) AS blank_status,
  CASE count(*) WHEN count(*) FILTER (status = 'Non-Commercial') THEN 0
    WHEN count(*) FILTER (status = 'Commercial') THEN 1
    WHEN count(*) FILTER (status IS NULL) THEN 3 ELSE 2 END AS sponsor_status
FROM sponsor_rows_outer GROUP BY trial""",
    "coded": f"""
SELECT trial_id, number_of_countries, min_end_date, max_end_date, comp_date,
  (has_results = number_of_countries)::INT AS has_results,
  (includes_pip > 0)::INT AS includes_pip,
  (includes_pip = 0 AND phase_1 = number_of_countries)::INT AS exempt,
  CASE number_of_countries WHEN single_blind THEN 1 WHEN not_single_blind THEN 0 ELSE 2 END
    AS single_blind,
  CASE number_of_countries WHEN rare_disease THEN 1 WHEN not_rare_disease THEN 0
    WHEN rare_disease_blank THEN 3 ELSE 2 END AS rare_disease,
  CASE number_of_countries WHEN phase_1 THEN 1 WHEN phase_2 THEN 2 WHEN phase_3 THEN 3
    WHEN phase_4 THEN 4 ELSE 0 END AS phase,
  CASE number_of_countries WHEN bioequivalence THEN 1 WHEN not_bioequivalence THEN 0 ELSE 2 END
    AS bioequivalence_study,
  CASE number_of_countries WHEN healthy_volunteers THEN 1 WHEN not_healthy_volunteers THEN 0
    ELSE 2 END AS health_volunteers,
  CASE WHEN ongoing = number_of_countries THEN 0
    WHEN completed + terminated = number_of_countries THEN 1
    WHEN completed + terminated > 0 AND completed + terminated < number_of_countries THEN 2
    WHEN no_status = number_of_countries THEN 4 ELSE 3 END AS trial_status,
  (terminated > 0)::INT AS any_terminated,
  (terminated = number_of_countries)::INT AS all_terminated,
  (completed + terminated = number_of_countries AND comp_date > 0
    AND coalesce(max_end_date < {CUTOFF}, false)
    AND NOT (includes_pip = 0 AND phase_1 = number_of_countries))::INT AS results_expected,
  (completed + terminated = number_of_countries AND comp_date = 0)::INT
    AS all_completed_no_comp_date,
  sponsor_status,
  CASE WHEN nullif(full_title, 'nan') IS NULL THEN coalesce(nullif(abbreviated_title, 'nan'), 'No Title')
    WHEN length(replace(replace(full_title, chr(13), ''), chr(10), '')) > 200
    THEN substr(replace(replace(full_title, chr(13), ''), chr(10), ''), 1, 200) || '...'
    ELSE replace(replace(full_title, chr(13), ''), chr(10), '') END AS trial_title,
  'https://www.clinicaltrialsregister.eu/ctr-search/search?query=' || trial_id AS trial_url,
  (comp_date > 0 AND completed + terminated > 0
    AND completed + terminated < number_of_countries)::INT AS comp_date_while_ongoing,
  (non_eu > 0)::INT AS contains_non_eu,
  (non_eu = number_of_countries)::INT AS only_non_eu
FROM rolled JOIN sponsor_status USING (trial_id)""",
    "classified": """
SELECT *, CASE
  WHEN only_non_eu = 1 THEN 'outside-eu'
  WHEN contains_non_eu = 1 THEN 'partly-outside-eu'
  WHEN exempt = 1 THEN CASE WHEN has_results = 1 THEN 'exempt-with-results' ELSE 'exempt' END
  WHEN trial_status IN (0, 2) THEN CASE
    WHEN comp_date_while_ongoing = 1 THEN 'error-ongoing-has-comp-date'
    WHEN has_results = 1 THEN 'ongoing-reported-early' ELSE 'ongoing' END
  WHEN trial_status = 1 THEN CASE
    WHEN all_completed_no_comp_date = 1 THEN 'error-completed-no-comp-date'
    WHEN results_expected = 0 THEN
      CASE WHEN has_results = 1 THEN 'completed-reported-early' ELSE 'completed-not-due' END
    WHEN has_results = 1 THEN 'reported' ELSE 'completed-due' END
  WHEN trial_status = 3 THEN 'other' WHEN trial_status = 4 THEN 'no-trial-status' END
  AS overall_status
FROM coded""",
    "study_names": """
SELECT DISTINCT trial AS trial_id, name AS name_of_sponsor FROM sponsor_rows_outer""",
    "suppliers": """
SELECT s_suppkey AS k, s_name, s_acctbal, n_name, r_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sheet": f"""
SELECT *, {slug("name_of_sponsor")} AS raw_slug, {slug("normalized_name")} AS slug,
  {slug("normalized_parent_name")} AS parent_slug
FROM (
  SELECT unnest([s_name, s_name || ' Ltd.']) AS name_of_sponsor,
    CASE WHEN k % 50 = 7 THEN 'Unclear Sponsor Name Given - ' || s_name
      WHEN k % 50 = 8 THEN 'Unknown Sponsor'
      ELSE n_name || ' Unit ' || (k % 3)::VARCHAR END AS normalized_name,
    CASE WHEN k % 50 = 7 THEN 'Unclear Sponsor Name Given'
      WHEN k % 50 = 8 THEN 'Unknown Sponsor'
      WHEN k % 3 < 2 THEN n_name || ' Unit 0'
      WHEN s_acctbal >= 5000 THEN r_name || ' Holdings'
      ELSE 'Independent Holdings' END AS normalized_parent_name,
    CASE WHEN k % 5 = 0 THEN 'https://proof.example/' || k::VARCHAR ELSE '' END AS "Proof",
    CASE WHEN k % 5 = 1 THEN 'merged' ELSE '' END AS "Description", '' AS "Notes", k
  FROM suppliers
  UNION ALL
  SELECT '', 'No Sponsor Name Given', 'No Sponsor Name Given', '', '', '', -1)""",
    "matched": f"""
SELECT c.*, coalesce(n.name_of_sponsor, '') AS name_of_sponsor_orig,
  {slug("coalesce(n.name_of_sponsor, '')")} AS raw_slug
FROM study_names n JOIN classified c USING (trial_id)""",
    "sponsor_trials": """
SELECT s.slug, m.trial_id, max(m.raw_slug) AS raw_slug, max(s.parent_slug) AS parent_slug,
  max(s.normalized_name) AS normalized_name,
  max(s.normalized_parent_name) AS normalized_parent_name,
  max(s.name_of_sponsor) AS name_of_sponsor,
  max(m.name_of_sponsor_orig) AS name_of_sponsor_orig, max(s."Proof") AS "Proof",
  max(s."Description") AS "Description", max(m.has_results) AS has_results,
  max(m.results_expected) AS results_expected, max(m.trial_status) AS trial_status,
  max(m.overall_status) AS overall_status,
  max(coalesce(m.max_end_date::VARCHAR, '')) AS max_end_date, max(m.trial_title) AS trial_title,
  max(m.all_terminated) AS all_terminated, max(m.trial_url) AS trial_url
FROM matched m JOIN sheet s USING (raw_slug) GROUP BY s.slug, m.trial_id""",
    "sponsor_counts": """
SELECT slug, max(normalized_name) AS sponsor_name,
  coalesce(sum(results_expected) FILTER (overall_status IN ('reported', 'completed-due')), 0)
    ::BIGINT AS total_due,
  coalesce(sum(has_results) FILTER (overall_status IN ('reported', 'completed-due')), 0)
    ::BIGINT AS total_reported,
  count(*) AS total_trials,
  count(*) FILTER (overall_status IN ('error-completed-no-comp-date', 'outside-eu',
    'partly-outside-eu', 'error-ongoing-has-comp-date', 'no-trial-status'))
    AS inconsistent_trials
FROM sponsor_trials GROUP BY slug""",
    "edges": """
SELECT slug, parent_slug, max(normalized_name) AS sponsor_name,
  max(normalized_parent_name) AS parent_name
FROM sponsor_trials WHERE slug <> parent_slug GROUP BY slug, parent_slug""",
    "all_counts": """
SELECT * FROM sponsor_counts
UNION ALL
SELECT parent_slug, max(normalized_parent_name), 0, 0, 0, 0 FROM sponsor_trials
WHERE parent_slug NOT IN (SELECT slug FROM sponsor_counts) GROUP BY parent_slug""",
    "sponsors": f"""
SELECT *, total_trials - total_due - inconsistent_trials AS not_yet_due_trials,
  total_due - total_reported AS total_unreported,
  {percent("total_reported", "total_due")} AS percent_reported,
  {percent("total_due - total_reported", "total_due")} AS percent_unreported,
  {percent("inconsistent_trials", "total_trials")} AS percent_bad_data,
  (total_trials >= 50 AND total_due > 0 AND sponsor_name <> 'Unknown Sponsor')::INT AS major
FROM all_counts""",
    "headline": f"""
SELECT (SELECT max(o_orderdate)::DATE::VARCHAR FROM orders) AS scrape_date,
  {CUTOFF}::VARCHAR AS due_date_cutoff, total_trials, due_trials, due_trials_with_results,
  due_trials_without_results, inconsistent_trials,
  {percent("due_trials_with_results", "due_trials")} AS percent_with_results,
  {percent("inconsistent_trials", "total_trials")} AS percent_inconsistent,
  (SELECT count(*) FROM sponsors) AS all_sponsors_count,
  (SELECT count(*) FROM sponsors WHERE major = 1) AS major_sponsors_count
FROM (SELECT count(DISTINCT trial_id) AS total_trials,
  count(DISTINCT trial_id) FILTER (results_expected = 1) AS due_trials,
  count(DISTINCT trial_id) FILTER (results_expected = 1 AND has_results = 1)
    AS due_trials_with_results,
  count(DISTINCT trial_id) FILTER (results_expected = 1 AND has_results = 0)
    AS due_trials_without_results,
  count(DISTINCT trial_id) FILTER (overall_status IN ('error-completed-no-comp-date',
    'outside-eu', 'partly-outside-eu', 'error-ongoing-has-comp-date', 'no-trial-status'))
    AS inconsistent_trials FROM sponsor_trials)""",
    "study_sponsors": """
SELECT DISTINCT n.trial_id, s.normalized_name
FROM matched n JOIN sheet s USING (raw_slug)""",
    "cohort_base": """
SELECT c.* EXCLUDE (has_results), c.has_results AS results,
  CASE WHEN number_of_countries BETWEEN 3 AND 99 THEN 3 ELSE number_of_countries END::INT
    AS country_count,
  year(max_end_date)::INT AS completionyear, p.normalized_name, p.multiple_sponsors,
  s.sponsor_trial_count,
  CASE WHEN p.normalized_name LIKE '%Unclear Sponsor Name Given%' THEN 2
       WHEN p.normalized_name = 'No Sponsor Name Given' THEN 1 ELSE 0 END AS bad_sponsor
FROM coded c
JOIN (SELECT trial_id, max(normalized_name) AS normalized_name,
        (count(*) > 1)::INT AS multiple_sponsors FROM study_sponsors GROUP BY trial_id) p
  USING (trial_id)
JOIN (SELECT normalized_name, count(*) AS sponsor_trial_count FROM study_sponsors
      GROUP BY normalized_name) s USING (normalized_name)
WHERE coalesce(year(max_end_date) NOT IN (2000, 2019, 2041), true)""",
    "size_ranks": """
SELECT sponsor_trial_count AS v, row_number() OVER (ORDER BY sponsor_trial_count) AS r,
  count(*) OVER () AS total FROM cohort_base""",
    "cohort": """
SELECT c.*,
  1 + (SELECT count(*) FROM size_cuts4 WHERE cut < sponsor_trial_count)::INT AS quartile,
  1 + (SELECT count(*) FROM size_cuts10 WHERE cut < sponsor_trial_count)::INT AS decile
FROM cohort_base c""",
    "due_cohort": """
SELECT * FROM cohort WHERE trial_status = 1 AND max_end_date IS NOT NULL
  AND max_end_date <= DATE '2000-06-30' AND NOT (phase = 1 AND includes_pip = 0)""",
}


def cut_points(ranks: str, bins: int) -> str:
    """Cut k of ``bins``: mean of two neighbours at a whole position, else the next value."""
    return f"""
SELECT k, CASE WHEN total * k % {bins} = 0
  THEN (max(v) FILTER (r = total * k // {bins}) + max(v) FILTER (r = total * k // {bins} + 1)) / 2
  ELSE max(v) FILTER (r = total * k // {bins} + 1) END::DOUBLE AS cut
FROM {ranks}, range(1, {bins}) AS g(k) GROUP BY k, total"""


VIEWS["size_cuts4"] = cut_points("size_ranks", 4)
VIEWS["size_cuts10"] = cut_points("size_ranks", 10)


def _needed(sql: str, done: list[str]) -> list[str]:
    for name, body in VIEWS.items():
        if name not in done and re.search(rf"(?<![\w.\"']){name}(?![\w\"'])", sql):
            if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
                _needed(body, done)
                if name not in done:
                    done.append(name)
    return done


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement with the views it uses in front of it."""
    extra = extra or {}
    names = _needed(" ".join([sql, *extra.values()]), [])
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    return f"WITH {', '.join(parts)}\n{sql}" if parts else sql
