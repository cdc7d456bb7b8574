"""Scans, sinks and the record stream."""

from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

from pyspark.sql import functions as F

from duelens import schema
from duelens.operators.staging import shared_folder, staged
from duelens.plans import more_queries
from duelens.sources import scans, sinks
from duelens.streaming import record_stream


def test_trial_csv_keeps_blanks_and_odd_text(spark, tmp_path):
    names = [f.name for f in schema.TRIAL_SCHEMA]
    odd = ' two\nlines, "quoted" '
    row = {f.name: 1 if f.dataType.simpleString() == "int" else "" for f in schema.TRIAL_SCHEMA}
    row |= {"trial_id": "t", "name_of_sponsor": odd}
    rows = spark.createDataFrame([tuple(row[n] for n in names)], schema.TRIAL_SCHEMA)
    path = str(tmp_path / "trials.csv")
    sinks.write_csv(rows, path, names)
    assert scans.read_trial_csv(spark, path).first() == rows.first()
    sinks.write_csv(rows.drop("exempt"), path)
    assert scans.read_trial_csv(spark, path).first().exempt is None


def test_record_dump_and_import(spark, tmp_path):
    sample = dict.fromkeys([f.name for f in schema.record_schema()])
    sample |= {
        "eudract_number_with_country": "1-DE",
        "full_title_of_the_trial": 'a "b",\nc',
        "trial_single_blind": True,
        "subject_childs": 3,
        "date_of_the_global_end_of_the_trial": date(2015, 10, 5),
        "meta_updated": datetime(2018, 1, 1, 12),
        "sponsors": [{k: "x" for k in schema.SPONSOR_KEYS}],
        "imps": [{"imp_role": "Test"}],
    }
    rows = spark.createDataFrame([sample], schema.record_schema())
    path = sinks.dump_table(rows, str(tmp_path), "dump.csv", datetime(2024, 1, 31, 23, 59, 59))
    assert path.endswith("/dump-2024-01-31-235959.csv")
    assert scans.read_record_csv(spark, path).first() == rows.first()
    odd = 'a\\n b\n c\\\\ "d"\r\n, \\'
    more = rows.withColumn("full_title_of_the_trial", F.lit(odd)).unionByName(rows)
    path = sinks.dump_table(more, str(tmp_path), "lines.csv", datetime(2024, 1, 31), one_line=True)
    back = scans.read_record_csv(spark, path, one_line=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, more.collect()))
    lines = [x for p in tmp_path.glob("lines*/part-*.csv") for x in p.read_bytes().splitlines()]
    assert len({x for x in lines if not x.startswith(b"eudract")}) == 2


def test_sheet_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("a", "A", "A", "", "", "n")], schema.SHEET_SCHEMA)
    sinks.write_csv(rows, str(tmp_path / "sheet"))
    assert scans.read_sponsor_sheet(spark, str(tmp_path / "sheet")).first() == rows.first()
    (tmp_path / "array.json").write_text('[\n {"name_of_sponsor": "x"},\n {"Notes": "y"}]')
    found = scans.read_json(spark, str(tmp_path / "array.json"), schema.SHEET_SCHEMA, one_array=True)
    assert [r.Notes for r in found.collect()] == [None, "y"]


def test_digest_sees_copies_but_not_order(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 7 = 0, NULL, id) AS v")
    assert not sinks.content_changed(rows, rows.repartition(5).orderBy(F.desc("id")))
    assert sinks.content_changed(rows, rows.union(rows.limit(2)))
    assert sinks.content_changed(rows, rows.withColumn("v", F.col("v") + 1))
    assert sinks.content_changed(rows, rows.limit(0))
    empty = rows.limit(0)
    assert not sinks.content_changed(empty, empty)


def test_meta_is_written_only_after_a_change(spark, tmp_path):
    rows = spark.range(10)
    meta = spark.createDataFrame([(date(2016, 12, 20), None, date(2018, 1, 17))], schema.META_SCHEMA)
    path = str(tmp_path / "meta")
    assert not sinks.write_meta_if_changed(rows, rows, meta, path)
    assert sinks.write_meta_if_changed(rows, rows.limit(9), meta, path)
    assert scans.read_json(spark, path, schema.META_SCHEMA).first().scrape_date == date(2018, 1, 17)


def test_staging_uses_the_named_folder(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder == shared_folder(spark)
    rows = staged(spark.range(5).withColumn("x", F.col("id") * 2))
    assert rows.count() == 5 and rows.columns == ["id", "x"]


def test_stream_of_records(spark, tmp_path):
    fields = "eudract_number_with_country string, meta_id string, v int, seen int"
    source, versions = str(tmp_path / "in"), str(tmp_path / "versions")
    checkpoint = str(tmp_path / "checkpoint")
    kind = spark.createDataFrame([], fields).schema

    def arrive(rows):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        record_stream.start_record_stream(stream, versions, checkpoint, ["seen"]).awaitTermination()

    def current(base=None):
        found = record_stream.read_current(spark, versions, kind, ["seen"], base_path=base)
        return {r.eudract_number_with_country: (r.meta_id, r.v) for r in found.collect()}

    arrive([("a", "1", 1, 1), ("a", "2", 2, 2), ("b", "3", 3, 1)])
    assert current() == {"a": ("1", 2), "b": ("3", 3)}
    arrive([("a", "4", None, 3), ("c", "5", 5, 3)])
    assert current() == {"a": ("1", None), "b": ("3", 3), "c": ("5", 5)}
    # A batch that is run again replaces its own files.
    again = spark.createDataFrame([("a", "4", None, 3), ("c", "5", 5, 3)], fields)
    record_stream._write_batch(versions, "eudract_number_with_country", ["seen"])(again, 1)
    assert current() == {"a": ("1", None), "b": ("3", 3), "c": ("5", 5)}
    base = str(tmp_path / "base")
    kept = record_stream.read_current(spark, versions, kind, ["seen"]).select(*kind.names)
    record_stream.compact(kept, base)
    assert current(base) == {"a": ("1", None), "b": ("3", 3), "c": ("5", 5)}


def test_the_dump_of_a_wide_table_takes_little_room(spark, tmp_path):
    """Hundreds of bytes a row were separators of missing fields, and the shuffle stayed beside them."""
    spark.range(500).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "1L AS l_suppkey", "1 AS l_linenumber", "cast(id % 50 AS double) AS l_quantity",
        "1D AS l_extendedprice", "0.05D AS l_discount", "0.04D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus",
        "timestamp_ntz '2020-01-01' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS s_suppkey, 'S' AS s_name, 1 AS s_nationkey, 1D AS s_acctbal").write.parquet(
        f"{tmp_path}/supplier.parquet"
    )
    before = {*Path(shared_folder(spark)).glob("dump-*")}
    rows = more_queries.record_dump_and_import(spark, str(tmp_path))
    (dump,) = {*Path(shared_folder(spark)).glob("dump-*")} - before
    written = sum(p.stat().st_size for p in dump.glob("records-*/part-*"))
    assert 0 < written < 100 * 500
    found = {r.eudract_number_with_country: r for r in rows.collect()}
    assert len(found) == 500 and rows.count() == 1000
    assert found["21-1"].full_title_of_the_trial == "Study 21\r\n of " + "long-term follow-up " * 5
    assert found["21-1"].status_of_the_sponsor in ("Commercial", None)
