"""Reading tables, with explicit schemas and pushed-down filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelens import schema


def blanks_for_nulls(rows: DataFrame) -> DataFrame:
    """Missing text as ''; CSV has no other way to tell them apart."""
    return rows.na.fill("")


def scan_records(records: DataFrame, seen_after: Column | None = None) -> DataFrame:
    """The columns the study table needs, of records updated after a moment."""
    wanted = records.select(*schema.STUDY_SCAN_COLUMNS, "meta_updated")
    if seen_after is not None:
        wanted = wanted.where(F.col("meta_updated") > seen_after)
    return wanted


def read_records_jdbc(
    spark: SparkSession, url: str, table: str, key_bounds: tuple[str, int, int, int] | None = None
) -> DataFrame:
    """The record table of a relational database; filters and columns are pushed to it.

    ``key_bounds`` is (numeric column, lower, upper, partitions) for a parallel read.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key_bounds:
        column, lower, upper, parts = key_bounds
        reader = reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts
        )
    return reader.load()


def read_trial_csv(spark: SparkSession, path: str) -> DataFrame:
    """Study rows from CSV, matched to columns by name, blanks kept as ''.

    Columns the file does not have are null.
    """
    header = spark.read.option("multiLine", True).option("header", True).option("escape", '"')
    present = header.csv(path).columns
    kinds = {f.name: f.dataType for f in schema.TRIAL_SCHEMA}
    as_text = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in present])
    rows = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    columns = [
        (F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.TRIAL_SCHEMA
    ]
    return blanks_for_nulls(rows.select(*columns))


def with_breaks(text: Column) -> Column:
    """What ``sinks.without_breaks`` has escaped; a null character stands for a backslash meanwhile."""
    for escaped, plain in (("\\\\", "\0"), ("\\n", "\n"), ("\\r", "\r"), ("\0", "\\")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def read_record_csv(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """A full dump of the record table with a header row; the three list columns come as JSON text and are parsed.

    Line breaks stand inside quotes, so a file is read by one task; with ``one_line`` they are
    escaped as ``sinks.dump_table`` does it, and a file is read in parts.
    """
    rows = (
        spark.read.schema(schema.record_csv_schema())
        .option("header", True)
        .option("multiLine", not one_line)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    if one_line:
        texts = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
        rows = rows.withColumns({c: with_breaks(F.col(c)) for c in texts})
    lists = {
        f.name: F.from_json(f.name, f.dataType)
        for f in schema.record_schema()
        if isinstance(f.dataType, T.ArrayType)
    }
    return rows.withColumns(lists)


def read_sponsor_sheet(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The reviewed sponsor names, from CSV or parquet, blanks kept as ''."""
    reader = spark.read.schema(schema.SHEET_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return blanks_for_nulls(reader.format(fmt).load(path))


def read_json(
    spark: SparkSession, path: str, table_schema: T.StructType, one_array: bool = False
) -> DataFrame:
    """JSON lines, or files that each hold one array or object."""
    return spark.read.schema(table_schema).option("multiLine", one_array).json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The headline history that ``sinks.write_history`` keeps, one row for each scrape date."""
    rows = spark.read.schema(schema.HEADLINE_SCHEMA).json(path)
    return rows.select(*schema.HEADLINE_SCHEMA.names)


def import_history(spark: SparkSession, path: str) -> DataFrame:
    """A history from elsewhere, one JSON object keyed by date; early rows lack some fields."""
    whole = spark.read.text(path, wholetext=True)
    by_date = F.from_json("value", T.MapType(T.StringType(), schema.HEADLINE_SCHEMA))
    return whole.select(F.explode(by_date)).select("value.*")
