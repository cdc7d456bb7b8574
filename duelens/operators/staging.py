"""Cutting a long lineage where a result is used several times."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_SCOPES: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Generated methods beyond 8000 bytes stay interpreted on HotSpot, which Spark's own setting allows for.
_METHOD_LIMIT, _COMPILED = "spark.sql.codegen.hugeMethodLimit", "8000"
# A join may use hash tables up to this size of a partition, as measured when its sides are shuffled.
_HASH_LIMIT, _HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"
_LISTS_HASHED = "spark.sql.execution.useObjectHashAggregateExec"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; the setting is read, never written.

    Only a local session without that setting gets a temporary folder, one for each application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="duelens-")
    return _LOCAL_FOLDERS[context.applicationId]


def new_path(spark: SparkSession, name: str = "staged") -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def staged(
    rows: DataFrame,
    keep: bool = False,
    wide: bool = False,
    lookups: bool = False,
    sort: bool = False,
) -> DataFrame:
    """Computed once and written as a table to the shared folder; survives lost executors.

    What reads it afterwards still reads only the columns and row groups it needs. The shuffle files
    of the job are removed as soon as the table is there, because nothing reads them again. ``keep`` leaves
    the table out of the scopes that ``discarding`` opened. ``wide`` is for jobs with aggregates of dozens of
    columns or long conditions: their code is generated operator by operator where one method would be too large to be compiled.
    ``lookups`` is for jobs that join long tables with narrow ones: where each shuffled partition of the narrow side
    proves small, it becomes a hash table and the long side is not sorted. ``sort`` is for jobs that make a short list
    for each of very many keys: rows are sorted once, instead of by both halves of an aggregate that gives up hashing.
    """
    spark = rows.sparkSession
    path = new_path(spark)
    settings = {_METHOD_LIMIT: _COMPILED} if wide else {}
    settings |= {_HASH_LIMIT: _HASHED} if lookups else {}
    settings |= {_LISTS_HASHED: "false"} if sort else {}
    with shuffles_removed(spark, settings):
        rows.write.parquet(path)
    if not keep:
        for paths in _SCOPES:
            paths.append(path)
    table = spark.read.schema(rows.schema).parquet(path)
    table._staged_at = path
    return table


@contextmanager
def shuffles_removed(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """For writing a table: the shuffle files of a job inside go when it ends; ``settings`` hold inside, too."""
    settings = {_CLEANUP: "true", **(settings or {})}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` wrote and that nothing will read again."""
    for table in tables:
        _remove(table.sparkSession, table._staged_at)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Removes all tables staged inside when the block ends, also by an error."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
