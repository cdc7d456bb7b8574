"""Writing tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelens.operators.staging import shuffles_removed


def write_json(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with keys in alphabetical order; ``order`` sorts the rows."""
    ordered = rows.orderBy(*order) if order else rows
    ordered.select(*sorted(rows.columns)).write.mode("overwrite").option(
        "ignoreNullFields", False
    ).json(path)


def write_history(rows: DataFrame, path: str) -> None:
    """Headline rows as JSON lines in a folder for each scrape date; other dates keep their files.

    A second run of a scrape replaces its row. ``scans.read_history`` reads what this writes.
    """
    rows.repartition("scrape_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).option("ignoreNullFields", False).partitionBy("scrape_date").json(path)


def _csv_writer(rows: DataFrame, mode: str):
    """Header, doubled quotes, text kept with its outer blanks."""
    return rows.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header in the given column order.

    The commit protocol puts the files in place only when all of them are written.
    """
    chosen = rows.select(*columns) if columns else rows
    _csv_writer(chosen, "overwrite").csv(path)


def stamped_name(name: str, now: datetime | None = None) -> str:
    """'dump.csv' -> 'dump-2024-01-31-235959.csv' (UTC)."""
    now = now or datetime.now(timezone.utc)
    stem, extension = name.rsplit(".", 1)
    return f"{stem}-{now:%Y-%m-%d-%H%M%S}.{extension}"


def without_breaks(text: Column) -> Column:
    """Line breaks as ``\\n`` and ``\\r``, backslashes doubled: a row is one line of the file."""
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def dump_table(
    rows: DataFrame,
    folder: str,
    name: str,
    now: datetime | None = None,
    one_line: bool = False,
    compression: str | None = None,
) -> str:
    """The whole table as CSV under a name with the time; nested columns become JSON text.

    With ``one_line`` line breaks are escaped, so that the files can be read in parts. ``compression`` (such as
    "gzip") makes the files of a wide table a small part of their size, because most of its fields are missing; the readers
    see it by the files' names, and a file is then read by one task. The shuffle files of the job are removed as
    soon as the dump is there.
    """
    path = f"{folder.rstrip('/')}/{stamped_name(name, now)}"
    flat = []
    for field in rows.schema:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        if one_line and isinstance(
            field.dataType, (T.ArrayType, T.MapType, T.StructType, T.StringType)
        ):
            value = without_breaks(value)
        flat.append(value.alias(field.name))
    with shuffles_removed(rows.sparkSession):
        _csv_writer(rows.select(*flat), "error").csv(path, compression=compression)
    return path


def content_digest(rows: DataFrame) -> DataFrame:
    """One row (n, digest) that does not depend on the order of rows.

    The sum of the row hashes counts copies, so adding a row twice changes it.
    """
    row_hash = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("digest"),
    )


def content_changed(before: DataFrame, after: DataFrame) -> bool:
    """True if the two tables do not hold the same rows; only two one-row results are read."""
    return content_digest(before).first() != content_digest(after).first()



def write_meta_if_changed(
    before: DataFrame, after: DataFrame, meta: DataFrame, meta_path: str
) -> bool:
    """Write ``meta`` only if the study table differs from the one before."""
    if not content_changed(before, after):
        return False
    write_json(meta, meta_path)
    return True
