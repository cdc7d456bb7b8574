"""Logistic regression on covariate patterns, reported as odds ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelens.operators.staging import staged


@dataclass(frozen=True)
class Factor:
    """A categorical term; ``base`` is its reference level (the smallest if not given)."""

    name: str
    base: int | None = None


# Terms of the full model, and base levels that are not the smallest.
CONTINUOUS_YEAR = "completionyear"
FACTORS = [
    Factor("phase", 3),
    Factor("sponsor_status"),
    Factor("includes_pip"),
    Factor("rare_disease"),
    Factor("bioequivalence_study"),
    Factor("health_volunteers"),
    Factor("quartile"),
    Factor("all_terminated"),
    Factor("bad_sponsor"),
    Factor("country_count"),
    Factor("multiple_sponsors"),
]


def term_names(terms: list[str | Factor]) -> list[str]:
    return [t.name if isinstance(t, Factor) else t for t in terms]


def covariate_patterns(
    rows: DataFrame, terms: list[str | Factor], outcome: str, weight: Column | None = None
) -> DataFrame:
    """Distinct combinations of covariates and outcome with their number of rows.

    The likelihood depends on nothing else, so the iterations run over this small
    table instead of the studies.  ``weight`` says how many studies a row stands for.
    """
    counted = F.lit(1.0) if weight is None else weight
    return rows.groupBy(outcome, *term_names(terms)).agg(F.sum(counted).alias("weight"))


def _without_perfect_levels(
    patterns: DataFrame, factors: list[Factor], outcome: str
) -> tuple[DataFrame, dict[str, list[int]]]:
    """Leave out non-base levels all of whose rows have the same outcome, with their rows.

    Such a level has no finite odds ratio.  What is left may make another level perfect, so this
    goes on until nothing changes.  Only (factor, level, outcome) counts are read.  When a factor's
    base is left out with other factors' levels, nothing can be compared with it: no rows are left.
    """
    entries = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.col(f.name).cast("int").alias("level"))
          for f in factors]
    )
    kept: dict[str, list[int]] = {}
    bases: dict[str, int] = {}
    while factors:
        seen = (
            patterns.select(F.explode(entries).alias("e"), outcome)
            .groupBy("e.name", "e.level")
            .agg(F.min(outcome).alias("low"), F.max(outcome).alias("high"))
            .collect()
        )
        changed = False
        for factor in factors:
            rows = sorted(
                (r["level"], r["low"] != r["high"]) for r in seen if r["name"] == factor.name
            )
            present = [level for level, _ in rows]
            if not present or bases.get(factor.name, present[0]) not in present:
                return patterns.where("false"), {f.name: [] for f in factors}
            base = bases.setdefault(factor.name, base_level(factor, present))
            kept[factor.name] = [level for level, mixed in rows if mixed or level == base]
            if len(kept[factor.name]) < len(present):
                patterns = patterns.where(F.col(factor.name).isin(kept[factor.name]))
                changed = True
        if not changed:
            break
    return patterns, kept


def base_level(factor: Factor, present: list[int]) -> int:
    """The base asked for, which must be there, or the smallest level."""
    if factor.base is None:
        return present[0]
    if factor.base not in present:
        raise ValueError(f"{factor.name} has no level {factor.base}")
    return factor.base


def _independent(assembled: DataFrame, count: int) -> list[int]:
    """Positions of the features that are not constant and not combinations of earlier ones."""
    if count < 2:
        return list(range(count))
    matrix = Correlation.corr(assembled, "features").first()[0].toArray()
    kept: list[int] = []
    for i in range(count):
        if np.isnan(matrix[i]).sum() >= count - 1:
            continue
        unexplained = 1.0
        if kept:
            inner, cross = matrix[np.ix_(kept, kept)], matrix[np.ix_(kept, [i])]
            unexplained -= (cross.T @ np.linalg.lstsq(inner, cross, rcond=None)[0]).item()
        if unexplained > 1e-8:
            kept.append(i)
    return kept


@dataclass
class Fit:
    """A fitted model: its terms as columns, the counted patterns it was fitted to, its rows.

    A model that cannot be estimated, because no rows are left, has no terms and no ``model``.
    """

    names: list[str]
    design: DataFrame
    model: GeneralizedLinearRegressionModel | None
    used: float
    dropped: float


def _fit(
    rows: DataFrame, terms: list[str | Factor], outcome: str, weight: Column | None = None
) -> Fit:
    known = rows.na.drop(subset=[outcome, *term_names(terms)])
    counted = staged(covariate_patterns(known, terms, outcome, weight))
    factors = [t for t in terms if isinstance(t, Factor)]
    patterns, levels = _without_perfect_levels(counted, factors, outcome)
    every, used = (
        p.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0] for p in (counted, patterns)
    )
    if not used:
        return Fit([], patterns, None, 0.0, every)
    columns: list[tuple[str, Column]] = []
    for term in terms:
        if isinstance(term, str):
            columns.append((term, F.col(term).cast("double")))
            continue
        base = base_level(term, levels[term.name])
        columns += [
            (f"{term.name}={level}", (F.col(term.name) == level).cast("double"))
            for level in levels[term.name]
            if level != base
        ]

    def assembled(chosen: list[tuple[str, Column]]) -> DataFrame:
        features = [f"x{i}" for i in range(len(chosen))]
        design = patterns.select(
            F.col(outcome).cast("double").alias("label"),
            "weight",
            *[column.alias(x) for x, (_, column) in zip(features, chosen)],
        )
        return VectorAssembler(inputCols=features, outputCol="features").transform(design)

    columns = [columns[i] for i in _independent(assembled(columns), len(columns))]
    design = assembled(columns)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", weightCol="weight", maxIter=50, tol=1e-10
    ).fit(design)
    return Fit([name for name, _ in columns], design, model, used, every - used)


def odds_ratios(
    spark: SparkSession,
    rows: DataFrame,
    terms: list[str | Factor],
    outcome: str = "results",
    weight: Column | None = None,
) -> DataFrame:
    """Fit ``outcome`` on ``terms`` and return one row per term.

    Rows with a missing value in one of them are left out.

    Dummies are built one by one, so that each factor's base level is the one asked for.
    Levels that predict the outcome perfectly and terms that follow from earlier ones
    are left out; ``used`` and ``dropped`` say how many rows the fit has and how many went
    with such levels.  If no rows are left, the model is reported as not estimable: one row with nulls and
    ``used`` 0.  Only levels, a matrix of terms and the coefficients reach the driver.
    """
    fit = _fit(rows, terms, outcome, weight)
    summary = fit.model.summary if fit.model else None
    found = [("(intercept)", None, None, None, None)] if summary is None else [
        (name, float(b), float(se), float(z), float(p))
        for name, b, se, z, p in zip(
            [*fit.names, "(intercept)"],
            [*fit.model.coefficients, fit.model.intercept],
            summary.coefficientStandardErrors,
            summary.tValues,
            summary.pValues,
        )
    ]
    fitted = spark.createDataFrame(
        found, "term string, coefficient double, std_err double, z double, p_value double"
    )
    return fitted.select(
        "term",
        F.exp("coefficient").alias("odds_ratio"),
        "coefficient",
        "std_err",
        "z",
        "p_value",
        F.lit(fit.used).alias("used"),
        F.lit(fit.dropped).alias("dropped"),
    )


def fit_totals(
    spark: SparkSession, rows: DataFrame, terms: list[str | Factor], outcome: str = "results"
) -> DataFrame:
    """(term, observed, fitted, used, dropped): totals of each term over the rows with the outcome.

    At the maximum of the likelihood the total that was observed equals the one that the fitted
    probabilities give, for every term and the intercept.
    """
    fit = _fit(rows, terms, outcome)
    kind = "term string, observed double, fitted double, used double, dropped double"
    if fit.model is None:
        return spark.createDataFrame([("(intercept)", 0.0, 0.0, 0.0, fit.dropped)], kind)
    scored = fit.model.transform(fit.design)
    columns = [*[F.col(f"x{i}") for i in range(len(fit.names))], F.lit(1.0)]
    sums = [F.sum(F.col("weight") * F.col(y) * x) for x in columns for y in ("label", "prediction")]
    totals = scored.agg(*sums).first()
    return spark.createDataFrame(
        [
            (name, totals[2 * i], totals[2 * i + 1], fit.used, fit.dropped)
            for i, name in enumerate([*fit.names, "(intercept)"])
        ],
        kind,
    )


def single_factor_models(
    rows: DataFrame, factors: list[Factor], outcome: str = "results"
) -> DataFrame:
    """One model per factor: (model, term, n, odds_ratio, coefficient, std_err, z).

    A model with one factor is saturated, so its odds ratios follow from the counts of
    (factor, level, outcome): one aggregation for all of them, no fit.  A level with one
    outcome only has no finite odds ratio and shows nulls.
    """
    names = term_names(factors)
    counted = covariate_patterns(rows, factors, outcome)
    entries = F.array(
        *[F.struct(F.lit(n).alias("model"), F.col(n).cast("int").alias("level")) for n in names]
    )
    total = {
        code: F.sum(F.when(F.col(outcome) == code, F.col("weight")).otherwise(0)).cast("long")
        for code in (0, 1)
    }
    levels = (
        counted.select(F.explode(entries).alias("e"), outcome, "weight")
        .groupBy("e.model", "e.level")
        .agg(total[0].alias("n_0"), total[1].alias("n_1"))
        .where("level IS NOT NULL")
    )
    given = F.lit(None).cast("int")
    for factor in factors:
        if factor.base is not None:
            given = F.when(F.col("model") == factor.name, factor.base).otherwise(given)
    asked = F.col("level") == given
    bases = levels.groupBy("model").agg(
        F.coalesce(F.min(F.when(asked, F.col("level"))), F.min(F.when(given.isNull(), F.col("level"))))
        .alias("base"),
        *[
            F.coalesce(
                F.min(F.when(asked, F.col(c))), F.min_by(F.when(given.isNull(), F.col(c)), "level")
            ).alias(f"base_{c}")
            for c in ("n_0", "n_1")
        ],
    )
    counts = [F.expr(f"nullif({c}, 0)") for c in ("n_1", "n_0", "base_n_1", "base_n_0")]
    odds = (counts[0] / counts[1]) / (counts[2] / counts[3])
    error = F.sqrt(sum((1 / c for c in counts[1:]), 1 / counts[0]))
    return (
        levels.join(bases, "model")
        .where("level <> base")
        .select(
            "model",
            F.concat("model", F.lit("="), "level").alias("term"),
            (F.col("n_0") + F.col("n_1")).alias("n"),
            odds.alias("odds_ratio"),
            F.log(odds).alias("coefficient"),
            error.alias("std_err"),
            (F.log(odds) / error).alias("z"),
        )
    )
