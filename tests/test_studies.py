"""Cleaning, rollup, status and expiry."""

from __future__ import annotations

import itertools
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from duelens import schema
from duelens.operators import expiry, rollup
from duelens.operators.classify import with_overall_status
from duelens.operators.cleaning import clean_records
from duelens.plans import pipelines
from duelens.plans.catalogue import QUERIES
from duelens.sources import scans, upsert

NO_VALUES = dict.fromkeys(schema.STUDY_SCAN_COLUMNS)


def record(key, number="1", **values):
    row = {**NO_VALUES, "eudract_number": number, "eudract_number_with_country": key}
    row["sponsors"] = [{"name_of_sponsor": "S", "status_of_the_sponsor": "Commercial"}]
    return {**row, "meta_updated": datetime(2018, 1, 17), **values}


def frame(spark, rows):
    fields = {f.name: f for f in schema.record_schema()}
    wanted = [fields[c] for c in [*schema.STUDY_SCAN_COLUMNS, "meta_updated"]]
    return spark.createDataFrame(rows, type(schema.record_schema())(wanted))


def coded(spark, rows, cutoff="2016-12-20", rule="all"):
    done = pipelines.studies(frame(spark, rows), F.lit(cutoff).cast("date"), rule)
    return {r.trial_id: r for r in done.collect()}


def test_flags_of_three_valued_fields(spark):
    rows = [
        record("a", trial_single_blind=True, trial_bioequivalence_study=False),
        record("b-3rd", trial_condition_being_studied_is_a_rare_disease="Yes"),
        record("c", trial_results="View results",
               trial_condition_being_studied_is_a_rare_disease="Information not present in EudraCT"),
    ]
    a, b, c = clean_records(frame(spark, rows)).orderBy("eudract_number_with_country").collect()
    assert (a.trial_single_blind, a.not_single_blind) == (1, 0)
    assert (a.trial_bioequivalence_study, a.not_bioequivalence_study) == (0, 1)
    assert (b.trial_single_blind, b.not_single_blind) == (0, 0)
    assert (b.trial_condition_being_studied_is_a_rare_disease, b.non_eu, a.non_eu) == (1, 1, 0)
    assert (c.rare_disease_blank, c.not_rare_disease, c.trial_results, a.trial_results) == (
        1, 0, 1, 0)


def test_study_codes(spark):
    end = date(2015, 1, 1)
    done = {"end_of_trial_status": "Completed", "date_of_the_global_end_of_the_trial": end}
    phase_1 = {"trial_human_pharmacology_phase_i": True}
    pip = {"trial_is_part_of_a_paediatric_investigation_plan": True}
    rows = [
        record("due-1", "due", **done, trial_results="View results"),
        record("due-2", "due", end_of_trial_status="Prematurely Ended"),
        record("exempt", "exempt", **done, **phase_1),
        record("pip", "pip", **done, **phase_1, **pip),
        record("late", "late", **{**done, "date_of_the_global_end_of_the_trial": date(2016, 12, 20)}),
        record("nodate", "nodate", end_of_trial_status="Completed"),
        record("mixed-1", "mixed", **done),
        record("mixed-2", "mixed", end_of_trial_status="Ongoing"),
        record("blank", "blank"),
        record("withdrawn", "withdrawn", end_of_trial_status="Withdrawn"),
        record("away-3rd", "away", **done),
        record("part-3rd", "part", **done),
        record("part", "part", **done),
    ]
    found = coded(spark, rows)
    assert {k: r.overall_status for k, r in found.items()} == {
        "due": "completed-due",
        "exempt": "exempt",
        "pip": "completed-due",
        "late": "completed-not-due",
        "nodate": "error-completed-no-comp-date",
        "mixed": "error-ongoing-has-comp-date",
        "blank": "no-trial-status",
        "withdrawn": "other",
        "away": "outside-eu",
        "part": "partly-outside-eu",
    }
    due = found["due"]
    assert (due.any_terminated, due.all_terminated, due.has_results, due.phase) == (1, 0, 0, 0)
    assert coded(spark, rows, rule="any")["due"].overall_status == "reported"
    assert found["exempt"].phase == 1 and found["exempt"].results_expected == 0


def test_sponsor_status_counts_empty_lists_as_blank(spark):
    def entry(status):
        return {"name_of_sponsor": "n", "status_of_the_sponsor": status}

    rows = [
        record("a", "blank", sponsors=None),
        record("b", "blank", sponsors=[]),
        record("c", "com", sponsors=[entry("Commercial"), entry("Commercial")]),
        record("d", "non", sponsors=[entry("Non-Commercial")]),
        record("e", "mix", sponsors=[entry("Commercial"), entry(None)]),
    ]
    found = {k: r.sponsor_status for k, r in coded(spark, rows).items()}
    assert found == {"blank": 3, "com": 1, "non": 0, "mix": 2}
    names = rollup.unnest_sponsors(frame(spark, rows))
    assert names.count() == 7 and rollup.unnest_sponsors(frame(spark, rows), False).count() == 5


def expected_status(t):
    if t["only_non_eu"]:
        return "outside-eu"
    if t["contains_non_eu"]:
        return "partly-outside-eu"
    results = t["has_results"]
    if t["exempt"]:
        return "exempt-with-results" if results else "exempt"
    status = t["trial_status"]
    if status in (0, 2):
        if t["comp_date_while_ongoing"]:
            return "error-ongoing-has-comp-date"
        return "ongoing-reported-early" if results else "ongoing"
    if status == 1:
        if t["all_completed_no_comp_date"]:
            return "error-completed-no-comp-date"
        if not t["results_expected"]:
            return "completed-reported-early" if results else "completed-not-due"
        return "reported" if results else "completed-due"
    return {3: "other", 4: "no-trial-status"}[status]


def test_overall_status_for_every_combination(spark):
    names = ["only_non_eu", "contains_non_eu", "exempt", "has_results", "comp_date_while_ongoing",
             "all_completed_no_comp_date", "results_expected"]
    rows = [
        dict(zip([*names, "trial_status"], [*bits, status]))
        for bits in itertools.product((0, 1), repeat=len(names))
        for status in range(5)
    ]
    columns = [*names, "trial_status"]
    table = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns))
    for r in with_overall_status(table).collect():
        assert r.overall_status == expected_status(r.asDict())


@pytest.mark.parametrize(
    "days, cutoff",
    [
        (["2021-01-01", "2020-12-01", "2020-11-01"], "2020-11-01"),
        (["2021-01-01", "2020-12-01", "2020-11-06", "2020-11-05", "2020-11-04", "2020-11-03",
          "2020-11-02", "2020-11-01"], "2020-11-02"),
        (["2021-01-01"], "2020-12-31"),
        (["2000-05-01", "2000-01-01"], "1999-12-31"),
        (["2000-05-01", "2000-04-01", "2000-03-05", "2000-01-01"], "2000-01-01"),
        (["2021-01-03", "2021-01-02", "2021-01-01"], "2021-01-01"),
    ],
)
def test_expiry_cutoff(spark, days, cutoff):
    table = spark.createDataFrame([(d,) for d in days], "d string")
    row = expiry.expiry_cutoff(expiry.scrape_dates(table, "d")).first()
    assert (str(row.last_scrape), str(row.cutoff)) == (days[0], cutoff)


def test_old_records_expire(spark):
    days = ["2000-01-01", "2000-03-05", "2000-04-01", "2000-05-01"]
    rows = [record(d, d, meta_updated=datetime.fromisoformat(d)) for d in days]
    table, meta = pipelines.build_study_table(frame(spark, rows))
    assert sorted(r.trial_id for r in table.collect()) == days[1:]
    assert str(meta.first().due_date_cutoff) == "1999-04-03"
    two = [r for r in rows if r["eudract_number"] in (days[0], days[3])]
    table, _ = pipelines.build_study_table(frame(spark, two))
    assert table.count() == 2


def test_scan_reads_only_its_columns_and_pushes_the_filter(spark, tmp_path):
    path = str(tmp_path / "warehouse")
    rows = frame(spark, [record("a"), record("b")]).withColumn("other", F.lit("x"))
    rows.write.parquet(path)
    live = scans.scan_records(spark.read.parquet(path), F.lit("2018-01-01").cast("timestamp"))
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(meta_updated" in plan and "other" not in plan
    assert live.count() == 2


def test_upsert_replaces_whole_rows(spark):
    then, now = datetime(2020, 1, 1), datetime(2021, 1, 1)
    current = spark.createDataFrame(
        [("a", "id-a", date(2015, 10, 5), "x", then, then), ("b", "id-b", None, "y", then, then)],
        "eudract_number_with_country string, meta_id string, "
        "date_of_the_global_end_of_the_trial date, end_of_trial_status string, "
        "meta_created timestamp, meta_updated timestamp",
    )
    incoming = spark.createDataFrame(
        [("a", "id-2", "z"), ("c", "id-c", "w")],
        "eudract_number_with_country string, meta_id string, end_of_trial_status string",
    )
    done = upsert.upsert(current, incoming, F.lit(now))
    rows = {r.eudract_number_with_country: r for r in done.collect()}
    a = rows["a"]
    assert (a.meta_id, a.end_of_trial_status, a.date_of_the_global_end_of_the_trial) == (
        "id-a", "z", None)
    assert (a.meta_created, a.meta_updated) == (then, now)
    assert (rows["b"].end_of_trial_status, rows["b"].meta_updated) == ("y", then)
    assert (rows["c"].meta_id, rows["c"].meta_created) == ("id-c", now)


def test_latest_by_key_with_one_very_common_key(spark):
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 500)) AS k", "id AS v", "id * 2 AS w"
    )
    best = {r.k: (r.v, r.w) for r in rollup.latest_by_key(rows, ["k"], ["v"]).collect()}
    expected = {}
    for r in rows.collect():
        expected[r.k] = max(expected.get(r.k, (-1, -1)), (r.v, r.w))
    assert best == expected


def test_the_study_table_needs_one_scan_and_one_exchange(spark):
    """Key reduction, roll-up, sponsor statuses and names all stay where the records have been dealt."""
    table = QUERIES["study_table"](spark, "/root/testdata/sf0.001")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("FileScan parquet [l_orderkey") == 1
    assert plan.count("Exchange hashpartitioning(") == 1
    assert "Exchange hashpartitioning(eudract_number" in plan


def test_records_dealt_by_study_are_reduced_alike(spark):
    rows = spark.createDataFrame(
        [("1", "1-DE", 5), ("1", "1-DE", 7), ("1", "1-FR", 2), ("2", "2-DE", None), ("2", "2-DE", 1)],
        "eudract_number string, eudract_number_with_country string, v int",
    )
    dealt = rollup.unique_records(rollup.by_study(rows), study="eudract_number")
    assert dealt.columns == rows.columns
    assert {tuple(r) for r in dealt.collect()} == {tuple(r) for r in rollup.unique_records(rows).collect()}
    assert {tuple(r) for r in dealt.collect()} == {("1", "1-DE", 7), ("1", "1-FR", 2), ("2", "2-DE", 1)}


def test_studies_and_names_from_rows_by_name(spark):
    """The same codes and names as from sums and lists of names, without buffers that make Spark sort (F11 to F14, F18 to F24)."""
    statuses = ["Completed", "Prematurely Ended", "Ongoing", "Withdrawn", None]
    kinds = ["Commercial", "Non-Commercial", None]
    flags = [None, True, False]
    rows = []
    for i in range(400):
        of = i // 3 if i % 7 else i // 2
        sponsors = [
            {"name_of_sponsor": [None, "A", "B", ""][(i + k) % 4], "status_of_the_sponsor": kinds[(of + i * k) % 3]}
            for k in range(i % 4)
        ]
        rows.append(record(
            f"{i}-3rd" if of % 5 == 0 or i % 11 == 0 else f"{i}", str(of) if of else None,
            sponsors=None if i % 8 == 0 else sponsors,
            end_of_trial_status=statuses[of % 5 if i % 4 else i % 3],
            date_of_the_global_end_of_the_trial=date(2010 + i % 9, 1, 1) if of % 3 else None,
            trial_results="View results" if of % 4 < 2 or i % 2 else None,
            trial_is_part_of_a_paediatric_investigation_plan=flags[of % 3],
            trial_human_pharmacology_phase_i=flags[(of + i % 2) % 3],
            subject_healthy_volunteers=flags[of // 2 % 3],
            trial_condition_being_studied_is_a_rare_disease=["Yes", "No", None][of % 3],
        ))
    records, cutoff = frame(spark, rows), F.lit("2016-12-20").cast("date")
    rolled = rollup.roll_up(clean_records(records), names=True)
    wanted = with_overall_status(rollup.study_codes(rolled, cutoff))
    columns = [c for c in [*rollup.TRIAL_COLUMNS, "overall_status"] if c in wanted.columns]
    columns = [c for c in columns if c not in ("comp_date", "trial_title")]
    studies, names = pipelines.named_studies(records, cutoff, columns)
    assert sorted(map(str, studies.collect())) == sorted(map(str, wanted.select(columns).collect()))
    pairs = wanted.select("trial_id", F.explode("sponsor_names").alias("name_of_sponsor"))
    assert sorted(map(str, names.collect())) == sorted(map(str, pairs.collect()))
    by_name = rollup.roll_up_by_name(clean_records(records))
    for table in (by_name, rollup.merge_names(by_name)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def _cohort_inputs(spark):
    """Records with null studies, blank, repeated and not reviewed names, and the sheet."""
    rows = []
    for i in range(300):
        sponsors = [
            {"name_of_sponsor": [None, "A", "a", "B Ltd", "C", "new"][(i // 2 + k * k) % 6],
             "status_of_the_sponsor": [None, "Commercial", "Non-Commercial"][(i // 3 + k * (i % 2)) % 3]}
            for k in range(i % 4)
        ]
        of = i // 3 if i % 7 else i // 2
        rows.append(record(
            f"{of}-{i}", str(of) if of % 40 else None, sponsors=None if i % 8 == 0 else sponsors,
            end_of_trial_status=["Completed", "Prematurely Ended", "Ongoing", None][of % 4],
            date_of_the_global_end_of_the_trial=date(2010 + i % 9, 1, 1) if of % 3 else None,
            trial_results="View results" if of % 4 < 2 else None,
        ))
    known = [("A", "Alpha"), ("B Ltd", "Beta"), ("C", "Alpha"), ("", "No Sponsor Name Given")]
    sheet = spark.createDataFrame(
        [(raw, name, name, "", "", "") for raw, name in known],
        "name_of_sponsor string, normalized_name string, normalized_parent_name string, "
        "Proof string, Description string, Notes string",
    )
    return frame(spark, rows), sheet


def test_a_cohort_goes_by_study_once(spark, monkeypatch):
    """Names and studies are not joined by study; the rows are those of the longer way (F12, F13, F19 to F23)."""
    records, sheet = _cohort_inputs(spark)
    day = F.lit("2016-12-20").cast("date")
    plans = []
    plain = pipelines.staged

    def watched(rows, **kind):
        if "eudract_number" in rows.columns or "trial_id" in rows.columns:
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return plain(rows, **kind)

    with monkeypatch.context() as patched:
        patched.setattr(pipelines, "staged", watched)
        found = pipelines.record_cohort(records, day, sheet)
    assert [p.count("RepartitionByExpression [eudract_number#") for p in plans] == [0, 1, 0]
    assert not any("Join" in line and "trial_id#" in line for p in plans for line in p.splitlines())
    wanted = pipelines.study_cohort(
        pipelines.studies(records, day), rollup.unnest_sponsors(records), sheet
    )
    rows = found.collect()
    assert len(rows) > 50 and {r.multiple_sponsors for r in rows} == {0, 1}
    assert sorted(map(str, rows)) == sorted(map(str, wanted.select(*found.columns).collect()))


def test_marks_of_sponsors_need_no_lambda_expression(spark):
    """Such an expression is not compiled with the rest, so the sponsor lists would be copied (F12, F13, F19 to F23)."""
    rolled = rollup.roll_up_by_name(clean_records(_cohort_inputs(spark)[0]))
    assert "lambda" not in rolled._jdf.queryExecution().optimizedPlan().toString()
