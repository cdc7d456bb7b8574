"""Lookups, pages and searches that open only a part of a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from duelens.operators import browse, paging, text_index
from duelens.sources import record_table


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'höt', concat('s', id % 40)) AS slug", "id", "cast(NULL AS string) AS note"
    )
    record_table.create_table(rows, path, 16, "slug")
    for slug in ("höt", "s7", "none"):
        found = record_table.lookup(spark, path, slug, 16, "slug")
        assert {r.id for r in found.collect()} == {r.id for r in browse.by_slug(rows, slug).collect()}
        assert f"bucket#" in plan_of(found) and "PartitionFilters: [isnotnull(bucket" in plan_of(found)
    numbers = rows.select(record_table.bucket_of(F.col("slug"), 16).alias("b"), "slug").distinct()
    assert all(r.b == record_table.bucket_number(r.slug, 16) for r in numbers.collect())


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_of_a_sorted_table(spark, tmp_path, direction):
    rows = spark.range(500).selectExpr("id", "if(id % 7 = 0, NULL, if(id % 2 = 0, 1, id % 5)) AS v")
    order, tie, path = [("v", direction)], ["id"], str(tmp_path / "sorted")
    paging.write_sorted(rows, order, tie, path, ranges=8)
    whole = [tuple(r) for r in browse.sort_rows(rows, order, tie).collect()]
    for number, length in [(0, 10), (3, 33), (15, 33), (16, 33), (4, 100), (0, 1000), (9, 50), (10, 50)]:
        page = paging.read_page(spark, path, order, tie, number, length)
        assert [tuple(r) for r in page.collect()] == whole[number * length : (number + 1) * length]
    deep = paging.read_page(spark, path, order, tie, 40, 10)
    assert "PartitionFilters: [" in plan_of(deep)
    opened = deep.select(F.input_file_name()).distinct().count()
    assert 1 <= opened <= 2
    last, seen = None, whole[:40]
    while len(seen) < len(whole):
        last = dict(zip(["id", "v"], seen[-1], strict=True))
        seen += [tuple(r) for r in paging.page_after(rows, order, tie, last, 150).collect()]
    assert seen == whole


def test_no_rows_have_no_pages(spark, tmp_path):
    path = str(tmp_path / "sorted")
    paging.write_sorted(spark.range(3).toDF("id"), [], ["id"], path, ranges=4)
    assert paging.read_page(spark, path, [], ["id"], 5, 10).count() == 0
    assert paging.read_page(spark, path, [], ["id"], 0, 10).count() == 3


TEXTS = [
    "The old Mill", "the mill\nby the river", None, "", "ab", "abc", "ABCabc", "straße Ünder", "\U0001f600 smile",
    "aaaaaaa", "mill the", "x" * 5000 + "needle" + "y" * 5000,
]
QUERIES = [
    "the", "MILL the", '"the mill"', '"mill by"', "ab", "a", "abc", "abcabc", "needle", "xyz", "straße", "ünd", "e s",
    '"e s"', "aaaa", "il er", "", "\U0001f600",
]


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in enumerate(TEXTS)], "id long, text string, source string")
    path, columns = str(tmp_path / "index"), ["text", "source"]
    text_index.build_index(rows, "id", columns, path, buckets=16)
    for query in [*QUERIES, "src1 the", "rc2"]:
        found = text_index.search(spark, path, rows, "id", columns, query)
        wanted = browse.search(rows, query, columns)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    assert text_index.candidates(spark, path, "a of") is None
    some = text_index.candidates(spark, path, "needle")
    assert [r.id for r in some.collect()] == [11]
    assert "PartitionFilters: [bucket" in plan_of(some)
