"""A record table in hash buckets of its key, and digests that tell which buckets differ.

Every record lies in the folder of its bucket, so an upsert reads and rewrites only the buckets its batch
falls into; the files of all others stay as they are. Buckets come from the MD5 of the key, which
other tools can compute, too.

A tree of digests has a leaf for each bucket and a node for each ``FANOUT`` nodes below, up to one
root. Two tables are compared from the root down: only children of nodes that differ are looked at.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelens.operators.staging import discard, staged
from duelens.schema import RECORD_KEY
from duelens.sources.upsert import upsert

BUCKET = "bucket"
_SCHEMA = "_schema"
#: Enough for buckets of a few hundred MB in a table of 100 TB; small tables take fewer.
BUCKETS = 1 << 18
FANOUT = 16


def bucket_of(key: Column, buckets: int) -> Column:
    """The first 32 bits of the key's MD5, modulo the number of buckets; null keys are in bucket 0."""
    bits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce((bits % buckets).cast("int"), F.lit(0))


def in_buckets(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))


def bucket_number(value: str, buckets: int) -> int:
    """``bucket_of`` a text key that is known beforehand."""
    return int(hashlib.md5(value.encode()).hexdigest()[:8], 16) % buckets


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows dealt by bucket: small ones share a task, a large one is split over several."""
    return rows.hint("rebalance", F.col(BUCKET))


def _write(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` has; the others keep their files."""
    _by_bucket(rows).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(BUCKET).parquet(path)


def create_table(rows: DataFrame, path: str, buckets: int, key: str = RECORD_KEY) -> None:
    """The first version of a table; the folder must not hold one yet."""
    table = in_buckets(rows, key, buckets)
    _by_bucket(table).write.mode("error").partitionBy(BUCKET).parquet(path)
    # Beside the buckets, so that a table without records has columns, too.
    described = rows.sparkSession.createDataFrame([(table.schema.json(),)], "value string")
    described.coalesce(1).write.text(f"{path}/{_SCHEMA}")


def read_table(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """All records, or those of some buckets; other buckets' folders are not opened."""
    fields = json.loads(spark.read.text(f"{path}/{_SCHEMA}").first()[0])
    rows = spark.read.schema(T.StructType.fromJson(fields)).parquet(path)
    return rows if only is None else rows.where(F.col(BUCKET).isin(only))


def lookup(spark: SparkSession, path: str, value: str, buckets: int, key: str) -> DataFrame:
    """The rows with one value of the key; only its bucket is opened."""
    only = read_table(spark, path, [bucket_number(value, buckets)])
    return only.where(F.col(key) == value).drop(BUCKET)


def upsert_into(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    now: Column,
    buckets: int,
    key: str = RECORD_KEY,
    order: list[str] | None = None,
) -> list[int]:
    """``upsert`` of a batch into a table; returns the buckets it has rewritten. Rows without a key are left out.

    The driver sees the numbers of those buckets only. The new buckets are complete before the
    first old one is replaced, and the same batch may run again after a failure: records it has already
    put in come out the same.
    """
    batch = staged(in_buckets(incoming.where(F.col(key).isNotNull()), key, buckets))
    touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())
    if touched:
        old = read_table(spark, path, touched).drop(BUCKET)
        new = staged(in_buckets(upsert(old, batch.drop(BUCKET), now, key, order), key, buckets))
        _write(new, path)
        discard(new)
    discard(batch)
    return touched


def replace_changed(
    spark: SparkSession, path: str, rows: DataFrame, buckets: int, key: str = RECORD_KEY
) -> list[int]:
    """Make the table hold exactly ``rows``; buckets with equal digests keep their files.

    Returns the buckets that differed. A bucket that has lost all its records is emptied.
    """
    new = staged(in_buckets(rows, key, buckets))
    stored = read_table(spark, path)
    before = digest_tree(bucket_digests(stored.drop(BUCKET), key, buckets), buckets)
    after = digest_tree(bucket_digests(new.drop(BUCKET), key, buckets), buckets)
    changed = sorted(r[0] for r in changed_buckets(before, after, buckets).collect())
    if changed:
        _write(new.where(F.col(BUCKET).isin(changed)), path)
        kept = {r[0] for r in new.select(BUCKET).where(F.col(BUCKET).isin(changed)).distinct().collect()}
        _empty(spark, path, [b for b in changed if b not in kept])
    discard(new)
    return changed


def _empty(spark: SparkSession, path: str, buckets: list[int]) -> None:
    for bucket in buckets:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# --- digests -------------------------------------------------------------------------------


def bucket_digests(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """(node, n, digest) of each bucket that has rows; copies count, order and partitions do not."""
    row_hash = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return (
        in_buckets(rows.withColumn("__hash", row_hash), key, buckets)
        .groupBy(F.col(BUCKET).cast("long").alias("node"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("__hash").cast("string").alias("digest"))
    )


def depth_of(buckets: int) -> int:
    """Levels above the leaves."""
    depth = 0
    while FANOUT**depth < buckets:
        depth += 1
    return depth


def digest_tree(leaves: DataFrame, buckets: int) -> DataFrame:
    """(level, node, n, digest): the leaves are level 0, the root is the last level's node 0.

    A node's digest hashes those of its children with their places; at most ``FANOUT`` meet in one row.
    """
    rows = staged(leaves.withColumn("level", F.lit(0)))
    tree = rows.select("level", "node", "n", "digest")
    for level in range(1, depth_of(buckets) + 1):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        rows = rows.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.sum("n").alias("n"),
            F.sha2(F.to_json(children), 256).alias("digest"),
        )
        tree = tree.unionByName(rows.select(F.lit(level).alias("level"), "node", "n", "digest"))
    return tree


def root(tree: DataFrame) -> DataFrame:
    """(n, digest) of the whole table: one row, or none for an empty table."""
    return tree.orderBy(F.desc("level")).limit(1).select("n", "digest")


def changed_nodes(before: DataFrame, after: DataFrame, buckets: int) -> DataFrame:
    """(level, node, n_before, n_after) of the nodes that differ, from the root down."""
    found = None
    suspects = None
    for level in range(depth_of(buckets), -1, -1):
        old = before.where(F.col("level") == level).select("node", "n", "digest").alias("old")
        new = after.where(F.col("level") == level).select("node", "n", "digest").alias("new")
        differ = (
            old.join(new, F.col("old.node") == F.col("new.node"), "full_outer")
            .where(~F.col("old.digest").eqNullSafe(F.col("new.digest")))
            .select(
                F.coalesce("old.node", "new.node").alias("node"),
                F.coalesce("old.n", F.lit(0)).alias("n_before"),
                F.coalesce("new.n", F.lit(0)).alias("n_after"),
            )
        )
        if suspects is not None:
            parent = F.floor(F.col("node") / FANOUT) == F.col("parent")
            differ = differ.join(suspects, parent, "left_semi")
        suspects = differ.select(F.col("node").alias("parent"))
        rows = differ.withColumn("level", F.lit(level))
        found = rows if found is None else found.unionByName(rows)
    return found.select("level", "node", "n_before", "n_after")


def changed_buckets(before: DataFrame, after: DataFrame, buckets: int) -> DataFrame:
    """(bucket) of the leaves that differ."""
    leaves = changed_nodes(before, after, buckets).where("level = 0")
    return leaves.select(F.col("node").cast("int").alias(BUCKET))
