"""Study cohorts: derivations, filters, tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.functions import flags
from duelens.functions.dates import from_day_number
from duelens.functions.labels import COHORT_LABELS, label
from duelens.operators.lookup import lookup_join
from duelens.operators.quantile import quantile_bins
from duelens.operators.staging import staged

# Years left out as typing errors, first year used in the regressions,
# last end date of the due cohort, earlier limit used for the completeness counts.
DROPPED_YEARS = [2000, 2019, 2041]
FIRST_REGRESSION_YEAR = 2005
DUE_BY_DAY = 20807
COMPLETENESS_DAY = 20688

NO_NAME = "No Sponsor Name Given"
UNCLEAR_NAME = "Unclear Sponsor Name Given"

# The columns of coded studies that cohorts, their tables and models use.
STUDY_COLUMNS = [
    "trial_id",
    "number_of_countries",
    "min_end_date",
    "max_end_date",
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
]

# The variables tabulated for the paper.
TABLE_VARIABLES = [
    "results",
    "completionyear",
    "trial_status",
    "phase",
    "sponsor_status",
    "includes_pip",
    "rare_disease",
    "bioequivalence_study",
    "health_volunteers",
    "quartile",
    "bad_sponsor",
    "all_terminated",
    "multiple_sponsors",
    "country_count",
]


def keep_unless(rows: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where the condition holds; rows where it is unknown stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def numbered_names(names: DataFrame) -> DataFrame:
    """Each distinct ``normalized_name`` with a ``name_number``; a larger name has a larger number.

    The rows are written once, so that the numbers stay.
    """
    ordered = names.select("normalized_name").distinct().orderBy("normalized_name")
    return staged(ordered.withColumn("name_number", F.monotonically_increasing_id()))


def one_row_per_study(
    studies: DataFrame, study_sponsors: DataFrame, numbers: DataFrame | None = None
) -> DataFrame:
    """Studies with ``normalized_name``, number of sponsors and the sponsor's study count.

    ``study_sponsors`` has (trial_id, normalized_name); the largest name stands for the
    study, and a sponsor's count covers all its studies, named first or not.  Names go as numbers in the
    order of the names, because extremes of numbers fit a hash aggregate and those of texts need sorted rows;
    with ``numbers`` (``numbered_names``) the rows have their ``name_number`` already.
    """
    if numbers is None:
        numbers = numbered_names(study_sponsors)
        study_sponsors = lookup_join(study_sponsors, numbers, ["normalized_name"])
    dealt = study_sponsors.select("trial_id", "name_number").repartition("trial_id")
    pairs = staged(dealt.distinct(), lookups=True)
    per_study = pairs.groupBy("trial_id").agg(
        F.max("name_number").alias("name_number"),
        F.when(F.count(F.lit(1)) > 1, 1).otherwise(0).alias("multiple_sponsors"),
    )
    per_name = pairs.groupBy("name_number").agg(F.count(F.lit(1)).alias("sponsor_trial_count"))
    counted = staged(lookup_join(numbers, per_name, ["name_number"]))
    named = lookup_join(studies.join(per_study, "trial_id"), counted, ["name_number"])
    rest = [c for c in studies.columns if c != "normalized_name"]
    return named.select("normalized_name", *rest, "multiple_sponsors", "sponsor_trial_count")


def with_largest_name(studies: DataFrame, numbers: DataFrame) -> DataFrame:
    """``one_row_per_study`` for studies that hold their distinct ``name_numbers``, so names and studies need no join.

    ``studies`` is read twice, so it should be made of a written table.
    """
    named = studies.select(F.explode("name_numbers").alias("name_number"))
    per_name = named.groupBy("name_number").agg(F.count(F.lit(1)).alias("sponsor_trial_count"))
    counted = staged(lookup_join(numbers, per_name, ["name_number"]))
    largest = studies.where(F.col("trial_id").isNotNull()).withColumns(
        {
            "name_number": F.array_max("name_numbers"),
            "multiple_sponsors": F.when(F.size("name_numbers") > 1, 1).otherwise(0),
        }
    )
    rest = [c for c in studies.columns if c not in ("normalized_name", "name_numbers")]
    return lookup_join(largest, counted, ["name_number"]).select(
        "normalized_name", *rest, "multiple_sponsors", "sponsor_trial_count"
    )


def derive_variables(studies: DataFrame, dropped_years: list[int] | None = None) -> DataFrame:
    """Cohort variables; years known to be wrong are dropped, missing years stay."""
    years = DROPPED_YEARS if dropped_years is None else dropped_years
    derived = studies.withColumnRenamed("has_results", "results").withColumns(
        {
            "sponsor_status": flags.missing_to(F.col("sponsor_status"), 3),
            "country_count": flags.recode_count(F.col("number_of_countries")).cast("int"),
            "completionyear": F.year("max_end_date"),
            "bad_sponsor": flags.exact_or_pattern_flag(
                F.col("normalized_name"), NO_NAME, UNCLEAR_NAME
            ),
        }
    )
    return keep_unless(derived, F.col("completionyear").isin(years)) if years else derived


def with_sponsor_size_bins(rows: DataFrame) -> DataFrame:
    """Quartile and decile of the sponsor's number of studies, over study rows."""
    return quantile_bins(rows, "sponsor_trial_count", {"quartile": 4, "decile": 10})


def single_country(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("country_count") == 1)


def early_phase_without_pip() -> Column:
    return (F.col("phase") == 1) & (F.col("includes_pip") == 0)


def due_steps(last_day: int = DUE_BY_DAY) -> list[tuple[str, Column]]:
    """Steps that lead to the cohort of studies whose results are due."""
    return [
        ("all countries completed", F.col("trial_status") == 1),
        ("with a completion date", F.col("max_end_date").isNotNull()),
        ("completed by the last day", F.col("max_end_date") <= from_day_number(last_day)),
        ("not an early-phase study of adults", ~early_phase_without_pip()),
    ]


def completeness_steps(day: int = COMPLETENESS_DAY) -> dict[str, list[tuple[str, Column]]]:
    """The completeness series of the paper, each a list of steps."""
    later = ("not an early-phase study of adults", ~early_phase_without_pip())
    done = ("all countries completed", F.col("trial_status") == 1)
    dated = ("with a completion date", F.col("max_end_date").isNotNull())
    undated = ("without a completion date", F.col("max_end_date").isNull())
    partly = ("some countries completed", F.col("trial_status") == 2)
    return {
        "completed": [done, dated],
        "completed and dated": [
            later,
            done,
            dated,
            ("completed by the day", F.col("max_end_date") <= from_day_number(day)),
        ],
        "completed, no date": [later, done, undated],
        "partly completed, dated": [partly, dated],
    }


def cohort(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for _, condition in steps:
        rows = rows.where(condition)
    return rows


def attrition(rows: DataFrame, series: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """Rows left after each step of each series: (series, step, label, n).

    All steps of all series are counted in one pass.
    """
    columns, names = [], []
    for title, steps in series.items():
        passed = F.lit(True)
        for number, (text, condition) in enumerate([("all", F.lit(True)), *steps]):
            passed = passed & F.coalesce(condition, F.lit(False))
            columns.append(F.count_if(passed).alias(f"c{len(names)}"))
            names.append((title, number, text))
    counted = rows.agg(*columns)
    entries = [
        F.struct(
            F.lit(title).alias("series"),
            F.lit(number).alias("step"),
            F.lit(text).alias("label"),
            F.col(f"c{i}").alias("n"),
        )
        for i, (title, number, text) in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*entries)))


def _long_counts(rows: DataFrame, variables: list[str], extra: list[str]) -> DataFrame:
    """(variable, value, extra..., n).  Rows are counted by combination of all variables
    first, so that only distinct combinations are multiplied by the unpivot."""
    combined = rows.groupBy(*variables, *[c for c in extra if c not in variables]).agg(
        F.count(F.lit(1)).alias("n")
    )
    entries = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("int").alias("value"))
            for v in variables
        ]
    )
    return combined.select(F.explode(entries).alias("e"), *extra, "n").select(
        "e.variable", "e.value", *extra, "n"
    )


def frequencies(rows: DataFrame, variables: list[str]) -> DataFrame:
    """One-way tables of several variables, missing values a row of their own."""
    return (
        _long_counts(rows, variables, [])
        .groupBy("variable", "value")
        .agg(F.sum("n").alias("n"))
    )


def crosstabs(rows: DataFrame, variables: list[str], outcome: str = "results") -> DataFrame:
    """Two-way tables of several variables with a 0/1 outcome."""
    code = F.col(outcome)
    return (
        _long_counts(rows, variables, [outcome])
        .groupBy("variable", "value")
        .agg(
            F.sum(F.when(code == 0, F.col("n")).otherwise(0)).alias("n_0"),
            F.sum(F.when(code == 1, F.col("n")).otherwise(0)).alias("n_1"),
            F.sum(F.when(code.isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
            F.sum("n").alias("n"),
        )
    )


def two_way(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two variables together, missing values rows and columns of their own."""
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def outcomes_at_the_end(
    rows: DataFrame, series: dict[str, list[tuple[str, Column]]], outcome: str = "results"
) -> DataFrame:
    """(series, outcome, n): the outcome among the rows that pass all steps of each series.

    Each row is read once and counted for every series it passes.
    """
    titles = []
    for title, steps in series.items():
        passed = F.lit(True)
        for _, condition in steps:
            passed = passed & F.coalesce(condition, F.lit(False))
        titles.append(F.when(passed, F.lit(title)))
    return (
        rows.select(F.explode(F.array_compact(F.array(*titles))).alias("series"), outcome)
        .groupBy("series", outcome)
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Fixed value: two-sided 95 % point of the normal distribution.
Z_95 = 1.959963984540054


def _t_terms() -> list[float]:
    """Coefficients of 1/v, 1/v^2, ... in the expansion of the t point with v degrees of freedom.

    Abramowitz and Stegun, Handbook of Mathematical Functions, 26.7.5.
    """
    z = Z_95
    return [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


#: Up to here the points are exact; beyond, the expansion is off by less than 1e-7.
EXACT_FREEDOM = 30


def t_point(freedom: int) -> float:
    """Two-sided 95 % point of Student's t for a whole number of degrees of freedom.

    Bisection on the closed form of the probability between -t and t (the same book, 26.7.3 and 26.7.4).
    """

    def between(t: float) -> float:
        angle = math.atan(t / math.sqrt(freedom))
        cosine, odd = math.cos(angle), freedom % 2
        term = cosine if odd else 1.0
        total = 0.0
        for power in range(1 + odd, freedom, 2):
            total += term
            term *= cosine**2 * power / (power + 1)
        total *= math.sin(angle)
        return (angle + total) * 2 / math.pi if odd else total

    low, high = 0.0, 20.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if between(middle) < 0.95 else (low, middle)
    return (low + high) / 2


def t_95(freedom: Column) -> Column:
    """Two-sided 95 % point of Student's t; none without a degree of freedom."""
    point = F.lit(Z_95)
    for power, term in enumerate(_t_terms(), 1):
        point = point + F.try_divide(F.lit(term), F.pow(freedom, F.lit(power)))
    exact = F.array(*(F.lit(t_point(v)) for v in range(1, EXACT_FREEDOM + 1)))
    place = (freedom - 1).cast("int")
    return F.when(freedom > EXACT_FREEDOM, point).otherwise(F.get(exact, place))


# A printed table of the points for 1 to 30 degrees of freedom, against which ``t_point`` is checked.
T_TABLE = [
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
]


def t_95_sql(freedom: str) -> str:
    terms = [f"{term!r} / pow({freedom}, {power})" for power, term in enumerate(_t_terms(), 1)]
    return f"""CASE WHEN {freedom} > {EXACT_FREEDOM} THEN {Z_95!r} + {" + ".join(terms)}
      ELSE ({T_TABLE})[({freedom})::INT] END"""


def proportions(tables: DataFrame) -> DataFrame:
    """Share with the outcome, its standard error and a 95 % interval on the logit scale.

    The published Stata documentation of ``proportion`` describes this interval: the t point
    with n - 1 degrees of freedom around the logit.  A share of 0 or 1 has no interval.
    """
    n = (F.col("n_0") + F.col("n_1")).cast("double")
    share = F.try_divide(F.col("n_1").cast("double"), n)
    error = F.sqrt(F.try_divide(share * (1 - share), n - 1))
    logit = F.when((share > 0) & (share < 1), F.log(share / (1 - share)))
    half = t_95(n - 1) * F.try_divide(error, share * (1 - share))
    return tables.withColumns(
        {
            "proportion": share,
            "std_err": error,
            "ci_low": 1 / (1 + F.exp(-(logit - half))),
            "ci_high": 1 / (1 + F.exp(-(logit + half))),
        }
    )


def summary_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def date_discrepancy(rows: DataFrame) -> DataFrame:
    """Days between first and last end date, and a 0/1 flag for any difference."""
    days = F.date_diff("max_end_date", "min_end_date")
    return rows.withColumn("datedifference", days).withColumn(
        "discrepant_date", F.when(days >= 1, 1).otherwise(days)
    )


def with_labels(rows: DataFrame, variable: str) -> DataFrame:
    return rows.withColumn(f"{variable}_label", label(F.col(variable), COHORT_LABELS[variable]))


def one_per_group(rows: DataFrame, group: str, key: str, seed: int = 1) -> DataFrame:
    """One row per group, picked by a hash of key and seed.

    An aggregate that keeps the smallest hash, so a large group is never in one task.
    """
    rest = [c for c in rows.columns if c != group]
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    picked = rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(draw, key)).alias("r"))
    return picked.select(group, "r.*")
