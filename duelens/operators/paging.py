"""Pages of a sorted table without sorting it again.

A table is sorted once into ranges that follow each other, with the number of rows of each. A page opens the one or
two ranges it lies in, however far back it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelens.operators.browse import DEFAULT_PAGE_LENGTH, sort_keys
from duelens.operators.staging import staged

RANGE = "range"
_COUNTS = "_counts"


def write_sorted(
    rows: DataFrame, order: list[tuple[str, str]], tie: list[str], path: str, ranges: int = 64
) -> None:
    """Sort ``rows`` as ``browse.sort_rows`` does and write them in ranges with their counts.

    Rows that share a sort value are told apart by ``tie``, so a very common value may fill many ranges.
    """
    rows = staged(rows)
    keys = sort_keys(order, tie)
    sorted_rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    sorted_rows.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(path)
    stored = rows.sparkSession.read.schema(_stored(rows)).parquet(path)
    counts = stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/{_COUNTS}")


def _stored(rows: DataFrame):
    return rows.withColumn(RANGE, F.lit(0)).schema


def read_page(
    spark: SparkSession,
    path: str,
    order: list[tuple[str, str]],
    tie: list[str],
    number: int,
    length: int = DEFAULT_PAGE_LENGTH,
) -> DataFrame:
    """Page ``number`` (from 0) of a table that ``write_sorted`` wrote in the same order.

    The driver reads one number for each range.
    """
    start, end, before = number * length, (number + 1) * length, 0
    wanted: list[int] = []
    skipped = 0
    counts = spark.read.schema(f"{RANGE} int, n long").parquet(f"{path}/{_COUNTS}")
    for row in counts.orderBy(RANGE).collect():
        if before < end and before + row.n > start:
            skipped = skipped if wanted else before
            wanted.append(row[RANGE])
        before += row.n
    rows = spark.read.parquet(path)
    found = rows.where(F.col(RANGE).isin(wanted) if wanted else F.lit(False)).drop(RANGE)
    return found.orderBy(*sort_keys(order, tie)).offset(max(start - skipped, 0)).limit(length)


def page_after(
    rows: DataFrame, order: list[tuple[str, str]], tie: list[str], last: dict, length: int
) -> DataFrame:
    """The page after the row ``last`` (values of the sort columns): a condition, no offset."""
    columns = [*order, *((c, "asc") for c in tie)]
    follows: Column = F.lit(False)
    same: Column = F.lit(True)
    for name, direction in columns:
        value, column = last[name], F.col(name)
        if value is None:
            beyond = column.isNotNull() if direction == "asc" else F.lit(False)
        elif direction == "asc":
            beyond = column > value
        else:
            beyond = (column < value) | column.isNull()
        follows = follows | (same & beyond)
        same = same & column.eqNullSafe(F.lit(value))
    return rows.where(follows).orderBy(*sort_keys(order, tie)).limit(length)
