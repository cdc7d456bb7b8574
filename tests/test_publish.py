"""Published tables of a small register with known results."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from duelens import schema
from duelens.functions.text import web_slug
from duelens.operators import browse, quality, sponsors
from duelens.plans import pipelines
from duelens.sources import scans, upsert

# trial, countries, end date, dated, results, PIP, exempt, phase, status, expected, while
# ongoing, only outside, partly outside
STUDIES = {
    "2004-000406-51": (7, "2007-05-31", 3, 1, 0, 0, 2, 2, 0, 1, 0, 0),
    "2005-002892-34": (7, "2007-11-22", 6, 1, 0, 0, 3, 2, 0, 1, 0, 0),
    "2006-002907-15": (8, "2008-05-06", 5, 1, 0, 0, 3, 2, 0, 1, 0, 0),
    "2007-004299-38": (4, "", 0, 0, 0, 0, 3, 0, 0, 0, 0, 0),
    "2015-004907-22": (1, "", 0, 1, 0, 0, 3, 4, 0, 0, 0, 0),
    "2004-000028-34": (4, "2008-03-10", 2, 0, 0, 0, 3, 1, 1, 0, 0, 0),
    "2004-000033-11": (1, "2005-06-30", 1, 1, 0, 1, 3, 1, 1, 0, 1, 0),
}

# raw name, normalised name, parent, study
NAMES = [
    ("GlaxoSmithKline,s.r.o.", "GlaxoSmithKline", "GlaxoSmithKline", "2004-000406-51"),
    ("GlaxoSmithKline SIA Latvia", "GlaxoSmithKline", "GlaxoSmithKline", "2004-000406-51"),
    ("GlaxoSmithKline", "GlaxoSmithKline", "GlaxoSmithKline", "2004-000406-51"),
    ("GlaxoSmithkline, S.A.", "GlaxoSmithKline", "GlaxoSmithKline", "2004-000406-51"),
    ("Sepsicure LLC", "Sepsicure LLC", "Sepsicure LLC", "2004-000406-51"),
    ("AstraZeneca SAS", "Astrazeneca", "Astrazeneca", "2005-002892-34"),
    ("ASTRAZENECA", "Astrazeneca", "Astrazeneca", "2005-002892-34"),
    ("Actelion Pharmaceuticals Ltd", "Actelion Pharmaceuticals Ltd", "Johnson & Johnson",
     "2006-002907-15"),
    ("Pirkanmaan sairaanhoitopiiri", "Pirkanmaa Hospital", "Pirkanmaa Hospital",
     "2007-004299-38"),
    ("The University of Liverpool", "University of Liverpool", "University of Liverpool",
     "2007-004299-38"),
    ("The Royal Liverpool Hospital", "Royal Liverpool Hospitals", "Royal Liverpool Hospitals",
     "2007-004299-38"),
    ("Medicines Development (Infectious Diseases)",
     "Unclear Sponsor Name Given - Medicines Development (Infectious Diseases)",
     "Unclear Sponsor Name Given", "2015-004907-22"),
    ("Lilly S.A", "Lilly", "Lilly Megacorp", "2004-000028-34"),
    ("Bristol Myers Squibb International Corporation", "Bristol Myers Squib",
     "Bristol Myers Squib", "2004-000033-11"),
]


def trials(spark, extra=()):
    rows = []
    for name, _, _, trial in [*NAMES, *extra]:
        (n, end, dated, results, pip, exempt, phase, status, due, ongoing, only, part) = STUDIES[trial]
        known = {
            "trial_id": trial, "number_of_countries": n, "min_end_date": end, "max_end_date": end,
            "comp_date": dated, "has_results": results, "includes_pip": pip, "exempt": exempt,
            "phase": phase, "trial_status": status, "results_expected": due,
            "comp_date_while_ongoing": ongoing, "only_non_eu": only, "contains_non_eu": part,
            "name_of_sponsor": name, "trial_title": "t", "trial_url": "u", "sponsor_status": 1,
        }
        rows.append(tuple(known.get(f.name, 0) for f in schema.TRIAL_SCHEMA))
    return spark.createDataFrame(rows, schema.TRIAL_SCHEMA)


def sheet(spark):
    rows = [(raw, name, parent, "", "", "") for raw, name, parent, _ in NAMES]
    return spark.createDataFrame(rows, schema.SHEET_SCHEMA)


def meta(spark):
    return spark.createDataFrame(
        [(date(2016, 12, 20), None, date(2018, 1, 17))], schema.META_SCHEMA
    )


@pytest.fixture(scope="module")
def published(spark):
    return pipelines.publish(trials(spark), sheet(spark), meta(spark), threshold=1)


def test_study_rows(published):
    rows = {(r.slug, r.trial_id): r for r in published.trials.collect()}
    assert len(rows) == 10
    assert rows["lilly", "2004-000028-34"].overall_status == "completed-due"
    assert rows["lilly", "2004-000028-34"].parent_slug == "lilly-megacorp"
    assert rows["bristol-myers-squib", "2004-000033-11"].overall_status == "outside-eu"
    glaxo = rows["glaxosmithkline", "2004-000406-51"]
    assert (glaxo.raw_slug, glaxo.name_of_sponsor_orig) == (
        "glaxosmithklinesro", "GlaxoSmithkline, S.A.")
    assert {r.total_trials for r in rows.values()} == {1}


def test_sponsor_rows(published):
    rows = {r.slug: r for r in published.sponsors.collect()}
    assert len(rows) == 13
    lilly = rows["lilly"]
    assert (lilly.total_due, lilly.total_unreported, lilly.major) == (1, 1, 1)
    assert (lilly.percent_reported, lilly.percent_unreported, lilly.percent_bad_data) == (0, 100, 0)
    assert [tuple(p) for p in lilly.parents] == [("lilly-megacorp", "Lilly Megacorp")]
    parent = rows["johnson-johnson"]
    assert parent.total_trials == 0 and parent.percent_bad_data is None
    assert [c.slug for c in parent.children] == ["actelion-pharmaceuticals-ltd"]
    assert rows["pirkanmaa-hospital"].not_yet_due_trials == 1
    assert sum(r.major for r in rows.values()) == 1


def test_headline(published):
    row = published.headline.first().asDict()
    assert row == {
        "scrape_date": date(2018, 1, 17),
        "due_date_cutoff": date(2016, 12, 20),
        "total_trials": 7,
        "due_trials": 2,
        "due_trials_with_results": 1,
        "due_trials_without_results": 1,
        "inconsistent_trials": 5,
        "percent_with_results": 50.0,
        "percent_inconsistent": 71.4,
        "all_sponsors_count": 13,
        "major_sponsors_count": 1,
    }


def test_files(spark, published, tmp_path):
    folder = str(tmp_path)
    pipelines.write_published(published, folder)
    back = scans.read_history(spark, f"{folder}/headline_history")
    assert back.first() == published.headline.select(*back.columns).first()
    line = next((tmp_path / "all_sponsors").glob("part-*.json")).read_text().splitlines()[0]
    assert list(json.loads(line)) == sorted(json.loads(line))
    again = upsert.upsert_history(back, published.headline)
    assert again.count() == 1


def test_history_of_several_scrapes(spark, published, tmp_path):
    folder = str(tmp_path)
    old = spark.createDataFrame([{"scrape_date": date(2017, 1, 21), "total_trials": 29451}],
                                schema.HEADLINE_SCHEMA)
    pipelines.write_published(published, folder, history=old)
    first = next(tmp_path.glob("headline_history/scrape_date=2017-01-21/*.json"))
    later = published.headline.withColumn("scrape_date", F.lit(date(2018, 2, 1)))
    for total in (1, 2):
        figures = later.withColumn("total_trials", F.lit(total).cast("long"))
        pipelines.write_published(replace(published, headline=figures), folder)
    rows = scans.read_history(spark, f"{folder}/headline_history").orderBy("scrape_date").collect()
    assert [(r.scrape_date, r.total_trials) for r in rows] == [
        (date(2017, 1, 21), 29451), (date(2018, 1, 17), 7), (date(2018, 2, 1), 2)
    ]
    assert rows[0].due_date_cutoff is None
    assert rows[1].percent_inconsistent == 71.4
    assert first.exists()


def test_old_history_lacks_fields(spark, tmp_path):
    path = tmp_path / "history.json"
    path.write_text(json.dumps({"2017-01-21": {"scrape_date": "2017-01-21", "total_trials": 29451,
                                               "percent_with_results": 48.5}}, indent=1))
    row = scans.import_history(spark, str(path)).first()
    assert (row.total_trials, row.due_date_cutoff) == (29451, None)


def test_unmatched_names_stop_the_run(spark):
    more = [("unmatched", "", "", "2004-000406-51")]
    rows = trials(spark, more)
    with pytest.raises(quality.GateFailed) as failure:
        pipelines.sponsor_trials(rows, sheet(spark), "fail")
    work = quality.sorted_worklist(failure.value.rows).collect()
    assert (work[0].name_of_sponsor, work[0].normalized_name) == ("unmatched", "")
    assert work[0].trials == 1
    assert len(pipelines.sponsor_trials(rows, sheet(spark)).collect()) == 10


def test_worklist_is_flat_and_loses_no_id(spark):
    matched = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 50)).alias(
            "raw_slug"
        ),
        F.col("id").cast("string").alias("trial_id"),
        F.lit("raw").alias("name_of_sponsor_orig"),
        *[F.lit("").alias(c) for c in sponsors.SHEET_COLUMNS[1:]],
    )
    twice = matched.union(matched)
    ids = [int(r.trial_id) for r in quality.worklist_trials(twice).collect()]
    assert sorted(ids) == list(range(5_000))
    names = {r.raw_slug: r.trials for r in quality.worklist(twice).collect()}
    assert len(names) == 51 and names["hot"] == 1_667 and sum(names.values()) == 5_000


def test_sheet_gates(spark):
    bad = sheet(spark).unionByName(
        spark.createDataFrame(
            [("x", "Lilly Megacorp", "Upper", "", "", "")], schema.SHEET_SCHEMA
        )
    )
    assert [r.name for r in quality.grandparents(bad).collect()] == ["Lilly Megacorp"]
    with pytest.raises(quality.GateFailed):
        pipelines.check_sheet(bad)
    twice = sheet(spark).unionByName(sheet(spark).limit(1))
    with pytest.raises(quality.GateFailed):
        pipelines.check_sheet(twice)
    pipelines.check_sheet(sheet(spark))


def test_rules(spark):
    good = pipelines.sponsor_trials(trials(spark), sheet(spark))
    assert {r.violations for r in quality.violations(good, quality.study_rules()).collect()} == {0}
    assert quality.with_assertions(good, quality.study_rules()).count() == 10
    broken = good.withColumn("exempt", F.lit(2))
    found = {r.rule: r.violations for r in quality.violations(broken, quality.study_rules()).collect()}
    assert found["exempt_is_0_or_1"] == 10
    with pytest.raises(Exception, match="rule broken"):
        quality.with_assertions(broken, quality.study_rules()).count()
    assert quality.total_conflicts(sponsors.with_total_trials(good)).isEmpty()


def test_browsing(spark, published):
    table = published.sponsors
    assert browse.by_slug(table, "lilly").first().sponsor_name == "Lilly"
    assert browse.sponsors_by_due(browse.having_trials(table)).first().slug == "lilly"
    assert [r.slug for r in browse.major_sponsors(table).collect()] == ["lilly"]
    found = browse.search(table.select("slug", "sponsor_name"), 'MEGACORP "lilly m"').collect()
    assert [r.slug for r in found] == ["lilly-megacorp"]
    assert browse.search_words('one "two three" "four') == ["one", "two three", "four"]
    low = browse.sort_rows(table, [("percent_reported", "asc")], ["slug"])
    assert low.first().percent_reported is None
    high = browse.sort_rows(table, [("percent_reported", "desc")], ["slug"])
    assert browse.page(high, 0, 1).first().slug == "lilly"
    assert browse.page(high, 1, 10).count() == 3
    assert browse.page(high, 0, None).count() == 13


def test_slug_of_the_normalised_names(spark):
    row = spark.sql("SELECT 'Unclear Sponsor Name Given - Medicines (X)' AS v")
    assert row.select(web_slug(F.col("v"))).first()[0] == "unclear-sponsor-name-given-medicines-x"


def test_repeated_slugs_stop_pairs(spark):
    names = spark.createDataFrame([("1", "Lilly S.A")], "eudract_number string, name_of_sponsor string")
    assert pipelines.sponsor_pairs(names, sheet(spark)).count() == 1
    with pytest.raises(Exception, match="same slug"):
        pipelines.sponsor_pairs(names, sheet(spark).unionByName(sheet(spark))).count()
