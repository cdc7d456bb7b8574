"""Merged distinct counts against exact ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from duelens.operators import sketches


def test_merged_counts_are_close_to_exact_ones(spark):
    """The same studies in several scrapes and with several sponsors, one of which has a third of all rows."""
    rows = spark.range(120_000).selectExpr(
        "cast(id % 40000 AS string) AS trial_id",
        "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS slug",
        "id % 4 AS scrape",
        "cast(id % 40000 % 5 = 0 AS int) AS results_expected",
        "cast(id % 40000 % 10 = 0 AS int) AS has_results",
    )
    parts = sketches.study_sketches(rows, ["scrape", "slug"])
    for by in (["slug"], ["scrape"], []):
        found = sketches.estimates(sketches.merged(parts, by))
        exact = rows.groupBy(*by).agg(
            *(
                F.count_distinct(F.when(condition, F.col("trial_id"))).alias(f"exact_{name}")
                for name, condition in sketches.headline_groups().items()
            )
        )
        both = found.join(exact, by) if by else found.crossJoin(exact)
        for row in both.collect():
            for name in sketches.headline_groups():
                assert row[name] == pytest.approx(row[f"exact_{name}"], rel=0.025)


def test_groups_without_studies_count_none(spark):
    rows = spark.createDataFrame([("1", 0, 0, "a"), ("1", 0, 0, "a"), (None, 1, 1, "a")],
                                 "trial_id string, results_expected int, has_results int, slug string")
    (row,) = sketches.estimates(sketches.study_sketches(rows, ["slug"])).collect()
    assert (row.total_trials, row.due_trials, row.due_trials_with_results) == (1, 0, 0)
    assert sketches.merged(sketches.study_sketches(rows.limit(0), ["slug"]), ["slug"]).count() == 0
