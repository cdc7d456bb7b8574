"""Bucketed tables, digest trees and snapshots of the record stream."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from duelens.sources import record_table, upsert
from duelens.streaming import snapshots

FIELDS = "k string, meta_id string, v int, meta_created timestamp, meta_updated timestamp"
BUCKETS = 32


def frame(spark, rows):
    then = "timestamp'2001-01-01 00:00:00'"
    return spark.createDataFrame(rows, "k string, meta_id string, v int").selectExpr(
        "*", f"{then} AS meta_created", f"{then} AS meta_updated"
    )


def files(path) -> dict:
    return {p: p.stat().st_mtime_ns for p in Path(path).glob("bucket=*/part-*.parquet")}


def plain(rows, key="k"):
    return {r[key]: tuple(r) for r in rows.collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = frame(spark, [(f"r{i}", f"id{i}", i) for i in range(300)])
    record_table.create_table(rows, path, BUCKETS, "k")
    return path, rows


def test_an_upsert_rewrites_only_its_buckets(spark, table):
    path, rows = table
    before = files(path)
    batch = spark.createDataFrame(
        [("r7", "x", 70, 1), ("r7", "y", 71, 2), ("new", "z", 5, 1)], "k string, meta_id string, v int, n int"
    )
    now = F.lit("2002-01-01").cast("timestamp")
    touched = record_table.upsert_into(spark, path, batch, now, BUCKETS, "k", ["n"])
    assert 1 <= len(touched) <= 2
    after = files(path)
    same = {p for p in before if after.get(p) == before[p]}
    assert {p for p in before if int(p.parent.name.split("=")[1]) not in touched} == same
    wanted = plain(upsert.upsert(rows, batch, now, "k", ["n"]))
    found = record_table.read_table(spark, path)
    assert plain(found.drop(record_table.BUCKET)) == wanted
    # The same batch once more changes nothing but files.
    record_table.upsert_into(spark, path, batch, now, BUCKETS, "k", ["n"])
    assert plain(record_table.read_table(spark, path).drop(record_table.BUCKET)) == wanted
    scan = found.where(F.col("bucket") == touched[0])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan


def test_an_empty_batch_and_an_empty_table(spark, tmp_path):
    path, empty = str(tmp_path / "t"), frame(spark, [])
    record_table.create_table(empty, path, BUCKETS, "k")
    now = F.lit("2002-01-01").cast("timestamp")
    assert record_table.upsert_into(spark, path, empty.select("k", "v"), now, BUCKETS, "k") == []
    assert record_table.read_table(spark, path).count() == 0
    batch = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    record_table.upsert_into(spark, path, batch, now, BUCKETS, "k")
    assert {r.v for r in record_table.read_table(spark, path).collect()} == {1}


def test_only_changed_buckets_are_replaced(spark, table):
    path, rows = table
    before = files(path)
    assert record_table.replace_changed(spark, path, rows.repartition(5), BUCKETS, "k") == []
    assert files(path) == before
    new = rows.where("k <> 'r3'").withColumn("v", F.when(F.col("k") == "r9", -1).otherwise(F.col("v")))
    changed = record_table.replace_changed(spark, path, new, BUCKETS, "k")
    assert 1 <= len(changed) <= 2
    assert plain(record_table.read_table(spark, path).drop(record_table.BUCKET)) == plain(new)
    few = rows.where("k = 'r1'")
    record_table.replace_changed(spark, path, few, BUCKETS, "k")
    assert plain(record_table.read_table(spark, path).drop(record_table.BUCKET)) == plain(few)


def test_digest_tree(spark):
    rows = frame(spark, [(f"r{i}", f"id{i}", i) for i in range(300)])

    def tree(table):
        return record_table.digest_tree(record_table.bucket_digests(table, "k", 300), 300)

    first = tree(rows)
    assert first.groupBy("level").count().count() == record_table.depth_of(300) + 1 == 4
    assert record_table.root(first).first() == record_table.root(tree(rows.repartition(7))).first()
    twice = tree(rows.union(rows.where("k = 'r5'")))
    bucket = rows.where("k = 'r5'").select(record_table.bucket_of(F.col("k"), 300)).first()[0]
    nodes = record_table.changed_nodes(first, twice, 300).collect()
    assert sorted((r.level, r.node) for r in nodes) == [
        (0, bucket), (1, bucket // 16), (2, bucket // 256), (3, 0)
    ]
    assert {r.n_after - r.n_before for r in nodes} == {1}
    assert record_table.changed_nodes(first, first, 300).count() == 0
    empty = tree(rows.limit(0))
    assert record_table.root(empty).first() is None
    assert record_table.changed_buckets(empty, first, 300).count() == first.where("level = 0").count()


@pytest.fixture
def log(spark, tmp_path):
    """A log, and a function that lets rows arrive as one batch of its stream."""
    fields = "eudract_number_with_country string, meta_id string, v int, seen int"
    kind = spark.createDataFrame([], fields).schema
    source, path = str(tmp_path / "in"), str(tmp_path / "log")

    def arrive(rows):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        snapshots.start_log_stream(stream, path, ["seen"]).awaitTermination()

    return path, kind, arrive


def current(spark, path, kind, snapshot=None):
    found = snapshots.read_log(spark, path, kind, ["seen"], snapshot=snapshot)
    return {r[0]: (r.meta_id, r.v) for r in found.collect()}


def test_compaction_publishes_a_snapshot(spark, log):
    path, kind, arrive = log
    assert current(spark, path, kind) == {}
    assert snapshots.compact(spark, path, kind, ["seen"]) == snapshots.Snapshot()
    arrive([("a", "1", 1, 1), ("b", "2", 2, 1)])
    arrive([("a", "9", 3, 2)])
    first = snapshots.compact(spark, path, kind, ["seen"])
    assert (first.number, first.through) == (1, 1)
    assert snapshots.compact(spark, path, kind, ["seen"]) == first
    arrive([("a", "8", None, 3), ("c", "3", 4, 3)])
    wanted = {"a": ("1", None), "b": ("2", 2), "c": ("3", 4)}
    assert current(spark, path, kind) == wanted
    second = snapshots.compact(spark, path, kind, ["seen"])
    assert current(spark, path, kind) == wanted == current(spark, path, kind, first)
    retired = snapshots.remove_retired(spark, path)
    assert retired == sorted(["versions/batch=0", "versions/batch=1", "versions/batch=2", first.base])
    assert current(spark, path, kind) == wanted
    assert snapshots.newest(spark, path) == second


def test_a_failed_compaction_changes_nothing(spark, log, monkeypatch):
    path, kind, arrive = log
    arrive([("a", "1", 1, 1)])
    arrive([("a", "2", 2, 2)])

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "publish", fails)
        with pytest.raises(OSError, match="lost"):
            snapshots.compact(spark, path, kind, ["seen"])
    assert snapshots.newest(spark, path) == snapshots.Snapshot()
    assert current(spark, path, kind) == {"a": ("1", 2)}
    assert snapshots.compact(spark, path, kind, ["seen"]).number == 1
    assert current(spark, path, kind) == {"a": ("1", 2)}


def test_retired_folders_are_not_read(spark, log):
    path, kind, arrive = log
    arrive([("a", "1", 1, 1)])
    snapshots.compact(spark, path, kind, ["seen"])
    arrive([("b", "2", 2, 2)])
    opened = snapshots.read_log(spark, path, kind, ["seen"]).inputFiles()
    plan = snapshots.read_log(spark, path, kind, ["seen"])._jdf.queryExecution().toString()
    assert any("bases/" in f for f in opened)
    assert "PartitionFilters: [isnotnull(batch" in plan
