"""Lookup joins, quantiles, models."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from duelens.operators import cohort, logistic, lookup, quantile


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    facts = spark.range(9_000).selectExpr("if(id % 3 = 0, 0, id % 700) AS k", "id AS v")
    table = spark.range(500).selectExpr("id AS k", "id * 10 AS w")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = facts.join(table, "k", how)
        salted = lookup.salted_join(facts, table, ["k"], ["v"], how)
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
    with pytest.raises(ValueError):
        lookup.salted_join(facts, table, ["k"], ["v"], "full")


def test_lookup_join_leaves_the_choice_to_spark(spark):
    facts = spark.range(100).selectExpr("id % 10 AS k", "id AS v")
    table = spark.range(9).selectExpr("id AS k", "id AS w")
    joined = lookup.lookup_join(facts, table, ["k"], "left")
    assert "broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.v, r.w) for r in joined.collect()} == {
        (v, v % 10 if v % 10 < 9 else None) for v in range(100)
    }


def cut(values, p):
    ordered = sorted(values)
    position, rest = divmod(len(ordered) * round(p * 1000), 100_000)
    if rest:
        return float(ordered[position])
    return (ordered[position - 1] + ordered[position]) / 2


def test_bins_with_ties_against_brute_force(spark):
    random.seed(5)
    for size, spread in ((11, 3), (40, 10), (1000, 25), (1001, 100_000)):
        values = [random.randrange(spread) for _ in range(size)] + [7] * (size // 2)
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
        for bins in (4, 10):
            cuts = [cut(values, 100 * k / bins) for k in range(1, bins)]
            found = quantile.quantile_bin(rows, "v", bins, "b").distinct().collect()
            for r in found:
                wanted = None if r.v is None else 1 + sum(c < r.v for c in cuts)
                assert r.b == wanted


def test_detailed_summary_by_group(spark):
    random.seed(6)
    groups = {g: [random.gauss(g, 5) for _ in range(50 * g)] for g in (1, 2, 3)}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    for r in quantile.detailed_summary(rows, "v", ["g"]).collect():
        values = groups[r.g]
        mean = statistics.fmean(values)
        second = statistics.fmean((v - mean) ** 2 for v in values)
        fourth = statistics.fmean((v - mean) ** 4 for v in values)
        assert r.n == len(values) and math.isclose(r.mean, mean)
        assert math.isclose(r.kurtosis, fourth / second**2, rel_tol=1e-9)
        for p in quantile.DETAIL_PERCENTILES:
            assert math.isclose(r[f"p{p}"], cut(values, p))
    alone = quantile.detailed_summary(rows, "v").first()
    assert math.isclose(alone.p50, cut([v for vs in groups.values() for v in vs], 50))


def test_missing_years_are_kept(spark):
    rows = spark.createDataFrame([(2000,), (2001,), (None,)], "y int")
    assert cohort.keep_unless(rows, F.col("y") == 2000).count() == 2


def test_frequencies_count_missing_values(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "a int, results int")
    one = {(r.variable, r.value): r.n for r in cohort.frequencies(rows, ["a", "results"]).collect()}
    assert one == {("a", 1): 2, ("a", None): 1, ("a", 2): 1, ("results", 0): 1,
                   ("results", 1): 2, ("results", None): 1}
    two = {r.value: (r.n_0, r.n_1, r.n_missing) for r in cohort.crosstabs(rows, ["a"]).collect()}
    assert two == {1: (1, 1, 0), None: (0, 1, 0), 2: (0, 0, 1)}


def test_one_per_group(spark):
    rows = spark.range(3_000).selectExpr("if(id % 3 = 0, -1, id % 20) AS g", "id")
    first = cohort.one_per_group(rows, "g", "id", seed=1)
    picked = {r.g: r.id for r in first.collect()}
    assert picked == {r.g: r.id for r in first.collect()}
    assert len(picked) == rows.select("g").distinct().count()
    assert picked != {r.g: r.id for r in cohort.one_per_group(rows, "g", "id", seed=2).collect()}


def test_logistic_matches_closed_form_and_drops_hopeless_terms(spark):
    cells = {(0, 0): 40, (0, 1): 20, (1, 0): 15, (1, 1): 30, (2, 1): 9}
    rows = spark.createDataFrame(
        [(g, y, 2 * g, 1) for (g, y), n in cells.items() for _ in range(n)],
        "g int, results int, twice int, same int",
    )
    found = {r.term: r for r in logistic.odds_ratios(spark, rows, [logistic.Factor("g")]).collect()}
    assert set(found) == {"g=1", "(intercept)"}
    assert math.isclose(found["g=1"].odds_ratio, (30 / 15) / (20 / 40), rel_tol=1e-6)
    assert math.isclose(found["g=1"].std_err, math.sqrt(1 / 40 + 1 / 20 + 1 / 15 + 1 / 30), rel_tol=1e-5)
    some = rows.where("g < 2")
    terms = {r.term for r in logistic.odds_ratios(spark, some, ["g", "twice", "same"]).collect()}
    assert terms == {"g", "(intercept)"}
    other = logistic.odds_ratios(spark, some, [logistic.Factor("g", 1)]).collect()
    assert {r.term for r in other} == {"g=0", "(intercept)"}


def test_single_factors_need_no_fit(spark):
    cells = {(0, 0): 40, (0, 1): 20, (1, 0): 15, (1, 1): 30, (2, 1): 9, (None, 1): 5}
    rows = spark.createDataFrame(
        [(g, y, 1 - y) for (g, y), n in cells.items() for _ in range(n)],
        "g int, results int, h int",
    )
    factors = [logistic.Factor("g", 1), logistic.Factor("h")]
    found = {r.term: r for r in logistic.single_factor_models(rows, factors).collect()}
    assert set(found) == {"g=0", "g=2", "h=1"}
    assert math.isclose(found["g=0"].odds_ratio, (20 / 40) / (30 / 15), rel_tol=1e-12)
    assert math.isclose(found["g=0"].std_err, math.sqrt(1 / 40 + 1 / 20 + 1 / 15 + 1 / 30))
    assert (found["g=2"].n, found["g=2"].odds_ratio, found["h=1"].odds_ratio) == (9, None, None)


def test_levels_go_until_none_is_perfect_and_rows_are_counted(spark):
    cells = {(0, 0, 0): 5, (0, 0, 1): 6, (1, 0, 1): 4, (1, 1, 1): 3, (0, 1, 0): 2, (1, 2, 0): 7}
    rows = spark.createDataFrame(
        [(a, b, y) for (a, b, y), n in cells.items() for _ in range(n)], "a int, b int, results int"
    )
    terms = [logistic.Factor("a"), logistic.Factor("b")]
    found = logistic.odds_ratios(spark, rows, terms).collect()
    # b=2 goes first; then a=1 has one outcome only, and after it b=1.
    assert {r.term for r in found} == {"(intercept)"}
    assert {(r.used, r.dropped) for r in found} == {(11.0, 16.0)}
    totals = logistic.fit_totals(spark, rows, terms).collect()
    assert all(math.isclose(t.observed, t.fitted, abs_tol=1e-6) for t in totals)
    with pytest.raises(ValueError, match="no level 9"):
        logistic.odds_ratios(spark, rows, [logistic.Factor("a", 9)])


def test_t_points():
    known = {6: 2.4469, 10: 2.2281, 30: 2.0423, 120: 1.9799}
    for freedom, point in known.items():
        value = cohort.Z_95 + sum(t / freedom**k for k, t in enumerate(cohort._t_terms(), 1))
        assert math.isclose(value, point, abs_tol=3e-4)


def test_three_and_seven_bins_are_exact(spark):
    rows = spark.range(1, 30_001).selectExpr("id AS v")
    for bins in (3, 6, 7):
        found = quantile.quantile_bins(rows, "v", {"b": bins, "c": 4}).groupBy("b").count().collect()
        assert sorted(r["count"] for r in found) == sorted(
            30_000 * k // bins - 30_000 * (k - 1) // bins for k in range(1, bins + 1)
        )


def test_a_model_without_rows_is_not_estimable(spark):
    """Each level of h has one outcome only, and what is left of g's base goes with them."""
    rows = spark.createDataFrame(
        [(3, 1, 1), (3, 1, 1), (4, 2, 0), (4, 2, 0), (4, 2, 0)], "g int, h int, results int"
    )
    terms = [logistic.Factor("g", 3), logistic.Factor("h", 2)]
    (row,) = logistic.odds_ratios(spark, rows, terms).collect()
    assert (row.term, row.odds_ratio, row.used, row.dropped) == ("(intercept)", None, 0.0, 5.0)
    (total,) = logistic.fit_totals(spark, rows, terms).collect()
    assert (total.observed, total.fitted, total.used, total.dropped) == (0.0, 0.0, 0.0, 5.0)
    empty = logistic.odds_ratios(spark, rows.limit(0), terms).collect()
    assert [(r.used, r.dropped) for r in empty] == [(0.0, 0.0)]
    with pytest.raises(ValueError, match="no level 9"):
        logistic.odds_ratios(spark, rows, [logistic.Factor("g", 9)])


def test_t_points_are_those_of_the_printed_table(spark):
    for freedom, printed in enumerate(cohort.T_TABLE, 1):
        assert cohort.t_point(freedom) == pytest.approx(printed, abs=6e-7)
    rows = spark.range(0, 40).select("id", cohort.t_95(F.col("id").cast("double")).alias("t")).collect()
    points = {r.id: r.t for r in rows}
    assert points[0] is None
    assert points[1] == pytest.approx(12.706205, abs=1e-6)
    assert points[31] == pytest.approx(cohort.t_point(31), abs=1e-7)
    assert points[39] == pytest.approx(2.022691, abs=1e-6)


def test_cohorts_read_the_records_once(spark, monkeypatch):
    """All models share one cohort, and a cohort makes one pass over the line items."""
    from duelens.plans import catalogue
    from duelens.sources import testbed

    read = []
    lines = testbed.raw_lines
    monkeypatch.setattr(testbed, "raw_lines", lambda *a: read.append(1) or lines(*a))
    folder = "/root/testdata/sf0.001"
    assert catalogue.QUERIES["model_fits"](spark, folder).count() == len(catalogue.MODELS)
    assert len(read) == 1


def test_names_are_matched_once_for_each_distinct_name(spark):
    from duelens.operators import sponsors

    names = spark.createDataFrame(
        [("1", "Aé"), ("1", None), ("2", ""), (None, "Aé"), ("2", "b"), ("1", "Aé")],
        "trial_id string, name_of_sponsor string",
    )
    sheet = sponsors.with_slugs(
        spark.createDataFrame(
            [("aé", "A", "P", "", "", ""), ("", "None given", "P", "", "", "")],
            ", ".join(f"{c} string" for c in sponsors.SHEET_COLUMNS),
        )
    )
    columns = ["trial_id", "name_of_sponsor_orig", "raw_slug", "normalized_name", "slug"]
    wanted = sponsors.match_sponsors(names, sheet).select(columns)
    found = sponsors.match_names(names, sheet).select(columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_another_order_of_rows_is_not_dealt_into_a_fixed_number_of_tasks(spark):
    from duelens.plans import catalogue

    plan = catalogue.QUERIES["content_changes"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in text and "REPARTITION_BY_COL" in text


def test_one_row_per_study_takes_names_as_numbers_in_their_order(spark):
    names = {"1": ["b", "é", "B"], "2": ["b", "b"], "3": ["Z"], None: ["b", "Z"], "5": ["b"]}
    pairs = spark.createDataFrame(
        [(k, n) for k, found in names.items() for n in found], "trial_id string, normalized_name string"
    )
    studies = spark.createDataFrame([("1", 7), ("2", 8), ("3", None), ("4", 9), (None, 1)], "trial_id string, v int")
    numbers = cohort.numbered_names(pairs)
    ordered = [r.normalized_name for r in numbers.orderBy("name_number").collect()]
    assert ordered == sorted({n for found in names.values() for n in found}, key=str.encode)
    numbered = pairs.join(numbers, "normalized_name").drop("normalized_name")
    for found in (
        cohort.one_row_per_study(studies, pairs),
        cohort.one_row_per_study(studies, numbered, numbers),
    ):
        assert found.columns == ["normalized_name", "trial_id", "v", "multiple_sponsors", "sponsor_trial_count"]
        assert sorted(tuple(r) for r in found.collect()) == [
            ("Z", "3", None, 0, 2), ("b", "2", 8, 0, 4), ("é", "1", 7, 1, 1),
        ]
