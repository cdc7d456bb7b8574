"""Records arriving as a stream: append versions, read the current state, compact.

Each micro-batch is written once under its number, so a batch that is run again after a
failure replaces its own files only.  Nothing is rewritten while the stream runs; the
current table is an aggregation over base and versions, and ``compact`` makes a new base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from duelens.schema import RECORD_KEY
from duelens.sources.upsert import current_records

BATCH = "batch"


def _write_batch(versions_path: str, key: str, order: list[str]):
    def write(batch: DataFrame, batch_id: int) -> None:
        current_records(batch, order, key).select(*batch.columns).write.mode("overwrite").parquet(
            f"{versions_path}/{BATCH}={batch_id}"
        )

    return write


def start_record_stream(
    records: DataFrame,
    versions_path: str,
    checkpoint: str,
    order: list[str],
    key: str = RECORD_KEY,
    once: bool = True,
) -> StreamingQuery:
    """Write every micro-batch of ``records`` as versions, one row per key."""
    writer = records.writeStream.foreachBatch(_write_batch(versions_path, key, order)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_current(
    spark: SparkSession,
    versions_path: str,
    version_schema: T.StructType,
    order: list[str],
    key: str = RECORD_KEY,
    base_path: str | None = None,
) -> DataFrame:
    """The current record table from a base, if there is one, and all versions since."""
    stored = T.StructType([*version_schema.fields, T.StructField(BATCH, T.LongType())])
    versions = spark.read.schema(stored).option("basePath", versions_path).parquet(versions_path)
    if base_path:
        base = spark.read.schema(version_schema).parquet(base_path)
        versions = base.withColumn(BATCH, F.lit(-1).cast("long")).unionByName(versions)
    return current_records(versions, [BATCH, *order], key).drop(BATCH)


def compact(current: DataFrame, path: str) -> None:
    """Write the current table as the base of a stream that starts with new versions."""
    current.write.mode("overwrite").parquet(path)
