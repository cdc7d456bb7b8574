"""Numbered snapshots of a stream of record versions.

A log is a folder: ``versions/batch=N`` has what each micro-batch wrote, ``bases`` has compacted tables, and
``snapshots/snapshot=N`` has one row that names the base and the last batch that is in it. A reader
takes the newest snapshot, its base, and the batches after that one; folders of earlier batches
and bases are retired and not opened. ``compact`` writes a new base first and its snapshot last, in one small file, so a
compaction that fails at any point changes nothing for readers, and the next one starts over.
"""

from __future__ import annotations

from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from duelens.schema import RECORD_KEY
from duelens.sources.upsert import current_records
from duelens.streaming.record_stream import BATCH, start_record_stream

_MANIFEST = "snapshot long, base string, through long"


class Snapshot(NamedTuple):
    """Number, folder of the base (none before the first compaction), last batch in the base."""

    number: int = 0
    base: str | None = None
    through: int = -1


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def newest(spark: SparkSession, log: str) -> Snapshot:
    """The snapshot that readers take."""
    if not _exists(spark, f"{log}/snapshots"):
        return Snapshot()
    rows = spark.read.schema(_MANIFEST).parquet(f"{log}/snapshots")
    row = rows.orderBy(F.desc("snapshot")).first()
    return Snapshot(row.snapshot, row.base, row.through) if row else Snapshot()


def start_log_stream(
    records: DataFrame, log: str, order: list[str], key: str = RECORD_KEY, once: bool = True
) -> StreamingQuery:
    """Write every micro-batch of ``records`` to the log, one row per key."""
    return start_record_stream(records, f"{log}/versions", f"{log}/checkpoint", order, key, once)


def read_log(
    spark: SparkSession,
    log: str,
    version_schema: T.StructType,
    order: list[str],
    key: str = RECORD_KEY,
    snapshot: Snapshot | None = None,
) -> DataFrame:
    """The record table as of the newest snapshot (or the given one) and all batches after it."""
    return current_records(
        _live(spark, log, version_schema, snapshot or newest(spark, log)), [BATCH, *order], key
    ).drop(BATCH)


def _live(
    spark: SparkSession, log: str, version_schema: T.StructType, snapshot: Snapshot
) -> DataFrame:
    stored = T.StructType([*version_schema.fields, T.StructField(BATCH, T.LongType())])
    versions = spark.createDataFrame([], stored)
    if _exists(spark, f"{log}/versions"):
        # A condition on the folder's name: retired batches are not listed as input.
        versions = (
            spark.read.schema(stored)
            .option("basePath", f"{log}/versions")
            .parquet(f"{log}/versions")
            .where(F.col(BATCH) > snapshot.through)
        )
    if snapshot.base is None:
        return versions
    base = spark.read.schema(version_schema).parquet(f"{log}/{snapshot.base}")
    return base.withColumn(BATCH, F.lit(-1).cast("long")).unionByName(versions)


def compact(
    spark: SparkSession,
    log: str,
    version_schema: T.StructType,
    order: list[str],
    key: str = RECORD_KEY,
) -> Snapshot:
    """A new base from the newest snapshot and the batches since; publishes its snapshot and returns it.

    Runs between two batches of the stream. Without new batches nothing is written.
    """
    old = newest(spark, log)
    live = _live(spark, log, version_schema, old)
    through = live.agg(F.max(BATCH)).first()[0]
    if through is None or through <= old.through:
        return old
    base = f"bases/{old.number + 1:010d}-{uuid4().hex}"
    rows = current_records(live.where(F.col(BATCH) <= through), [BATCH, *order], key)
    rows.select(*version_schema.names).write.parquet(f"{log}/{base}")
    new = Snapshot(old.number + 1, base, through)
    publish(spark, log, new)
    return new


def publish(spark: SparkSession, log: str, snapshot: Snapshot) -> None:
    """Make ``snapshot`` the newest one; fails if its number is taken."""
    row = spark.createDataFrame([(snapshot.base, snapshot.through)], "base string, through long")
    row.coalesce(1).write.mode("error").parquet(f"{log}/snapshots/snapshot={snapshot.number}")


def remove_retired(spark: SparkSession, log: str) -> list[str]:
    """Delete the folders that the newest snapshot no longer names; returns them.

    For when no reader of an older snapshot is left.
    """
    snapshot = newest(spark, log)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(log).getFileSystem(spark._jsc.hadoopConfiguration())
    retired = []
    for folder in ("versions", "bases"):
        if not _exists(spark, f"{log}/{folder}"):
            continue
        for status in system.listStatus(hadoop.Path(f"{log}/{folder}")):
            name = status.getPath().getName()
            if folder == "versions":
                old = name.startswith(f"{BATCH}=") and int(name.split("=")[1]) <= snapshot.through
            else:
                old = snapshot.base is not None and f"bases/{name}" < snapshot.base
            if old:
                system.delete(status.getPath(), True)
                retired.append(f"{folder}/{name}")
    return sorted(retired)
