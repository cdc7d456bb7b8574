"""Exact order statistics and tie-aware quantile bins without a one-task window.

Values are counted first, so a very common value is one row.  The counted values are
cut into ranges of about equal size, running counts are formed inside each range in
parallel, and only the range totals (at most ``RANGES``) are added up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelens.operators.staging import staged

RANGES = 256

# The percentiles of a detailed summary.
DETAIL_PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def counted_values(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n) for the values that are present."""
    by = by or []
    return (
        rows.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _range_number(counted: DataFrame) -> Column:
    """Range of each value; the limits (fewer than ``RANGES`` numbers) are read at once."""
    shares = [i / RANGES for i in range(1, RANGES)]
    limits = counted.agg(F.percentile_approx("value", shares, F.lit(10_000))).first()[0]
    if not limits:
        return F.lit(0)
    found = F.array(*[F.lit(limit) for limit in sorted(set(limits))])
    return F.size(F.filter(found, lambda limit: limit < F.col("value")))


def running_counts(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n, upto, total): how many observations are at or below each value.

    The counted values are written once, because limits, ranges and totals all read them.
    """
    by = by or []
    counted = staged(counted)
    in_range = counted.withColumn("range", _range_number(counted))
    inside = Window.partitionBy(*by, "range").orderBy("value")
    within = in_range.withColumn("in_range", F.sum("n").over(inside))
    totals = in_range.groupBy(*by, "range").agg(F.sum("n").alias("range_n"))
    ranges = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.select(
        *[F.col(c).alias(f"{c}_again") for c in [*by, "range"]],
        (F.sum("range_n").over(ranges.orderBy("range")) - F.col("range_n")).alias("before"),
        F.sum("range_n").over(ranges).alias("total"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"{c}_again")) for c in [*by, "range"]]
    return within.join(offsets, same).select(
        *by,
        "value",
        "n",
        (F.col("before") + F.col("in_range")).alias("upto"),
        "total",
    )


def cutpoints(
    rows: DataFrame, value: str, shares: list[tuple[int, int]], by: list[str] | None = None
) -> DataFrame:
    """One row (per group) with ``cuts``: the value at each share (k, of n) of the observations.

    At a whole position the mean of the two neighbours, else the next order statistic.
    Positions are whole numbers throughout.
    """
    by = by or []
    running = running_counts(counted_values(rows, value, by), by)
    columns = []
    for k, n in shares:
        scaled = F.col("total") * k
        at = F.expr(f"total * {k} DIV {n}")
        lower = F.when(scaled % n == 0, at).otherwise(at + 1)
        low = F.min(F.when(F.col("upto") >= lower, F.col("value")))
        high = F.min(F.when(F.col("upto") >= at + 1, F.col("value")))
        columns.append((low.cast("double") + F.coalesce(high, low).cast("double")) / 2)
    return running.groupBy(*by).agg(F.array(*columns).alias("cuts"))


def quantile_bins(rows: DataFrame, value: str, bins: dict[str, int]) -> DataFrame:
    """A column of bins 1..n for each name; equal values share a bin, missing values have none.

    Values are counted once for all columns.  The cutpoints are read at once, so that the bins
    cost nothing afterwards.
    """
    shares = [(k, n) for n in bins.values() for k in range(1, n)]
    found = cutpoints(rows, value, shares).first()
    cuts = iter(found["cuts"] if found else [])
    columns = {}
    for name, n in bins.items():
        below = F.lit(0)
        for _, cut in zip(range(1, n), cuts):
            below = below + F.when(F.col(value) > cut, 1).otherwise(0)
        columns[name] = F.when(F.col(value).isNotNull(), below + 1).cast("int")
    return rows.withColumns(columns)


def quantile_bin(rows: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Bin 1..``bins`` by cutpoints."""
    return quantile_bins(rows, value, {name: bins})


def detailed_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, sd, variance, skewness, kurtosis, extremes and percentiles, per group."""
    by = by or []
    moments = rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.var_samp(value).alias("variance"),
        F.skewness(value).alias("skewness"),
        (F.kurtosis(value) + 3).alias("kurtosis"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    points = cutpoints(rows, value, [(p, 100) for p in DETAIL_PERCENTILES], by)
    if by:
        keyed = moments.select(*by, *[c for c in moments.columns if c not in by])
        on = [keyed[c].eqNullSafe(points[c]) for c in by]
        joined = keyed.join(points, on, "left").drop(*[points[c] for c in by])
    else:
        joined = moments.withColumn("cuts", points.scalar())
    return joined.select(
        *[c for c in joined.columns if c != "cuts"],
        *[F.col("cuts")[i].alias(f"p{p}") for i, p in enumerate(DETAIL_PERCENTILES)],
    )
