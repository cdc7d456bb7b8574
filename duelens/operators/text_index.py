"""Substring search over postings of trigrams.

A row's line (its columns taken together, as ``browse.search`` reads them) gives one posting for each of its distinct
three-character runs. A word of a query is in a line only if all its trigrams are, so postings are intersected first and
only the rows left are looked at. Words of less than three characters have no trigram; they are looked
for in the rows the other words leave, or in all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelens.operators.browse import search_condition, search_line, search_words
from duelens.sources.record_table import BUCKET, bucket_number, in_buckets

GRAM = 3
#: Trigrams whose postings are intersected for a query: the rarest.
MOST_GRAMS = 6
_MADE = "buckets int, kind string"
_COUNTS = f"gram string, n long, {BUCKET} int"


def grams_of(word: str) -> list[str]:
    """The distinct trigrams of a word or phrase, in lower case."""
    word = word.lower()
    return sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})


def postings(rows: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(gram, id): each distinct trigram of each row's line."""
    # A match of no length at every place that three characters follow: one pass over the line.
    every = F.regexp_extract_all("line", F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1))
    grams = F.array_distinct(every)
    lines = rows.select(F.col(row_id).alias("id"), search_line(columns).alias("line"))
    return lines.where(F.length("line") >= GRAM).select(F.explode(grams).alias("gram"), "id")


def build_index(
    rows: DataFrame, row_id: str, columns: list[str], path: str, buckets: int = 4096
) -> None:
    """Write the postings in buckets of their trigrams, and how many rows each trigram has.

    A trigram that most rows have fills several files of its bucket.
    """
    table = in_buckets(postings(rows, row_id, columns), "gram", buckets)
    table.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, "gram").write.partitionBy(
        BUCKET
    ).parquet(f"{path}/postings")
    counts = rows.sparkSession.read.schema(table.schema).parquet(f"{path}/postings")
    counts = counts.groupBy("gram", BUCKET).agg(F.count(F.lit(1)).alias("n"))
    counts.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/counts")
    spark = rows.sparkSession
    made = spark.createDataFrame([(buckets, table.schema["id"].dataType.simpleString())], _MADE)
    made.coalesce(1).write.parquet(f"{path}/_made")


def _pruned(rows: DataFrame, grams: list[str], buckets: int) -> DataFrame:
    """The rows of some trigrams; only their buckets are opened."""
    numbers = sorted({bucket_number(g, buckets) for g in grams})
    return rows.where(F.col(BUCKET).isin(numbers) & F.col("gram").isin(grams))


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(id) of the rows that have the rarest trigrams of the query's words; None if it has no trigram.

    The driver sees as many counts as the query has trigrams.
    """
    grams = sorted({g for word in search_words(query) for g in grams_of(word)})
    if not grams:
        return None
    buckets, kind = spark.read.schema(_MADE).parquet(f"{path}/_made").first()
    stored = spark.read.schema(_COUNTS).parquet(f"{path}/counts")
    counts = {r.gram: r.n for r in _pruned(stored, grams, buckets).collect()}
    rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:MOST_GRAMS]
    held = spark.read.schema(f"gram string, id {kind}, {BUCKET} int").parquet(f"{path}/postings")
    found = _pruned(held, rarest, buckets).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(rarest)).select("id")


def search(
    spark: SparkSession, path: str, rows: DataFrame, row_id: str, columns: list[str], query: str
) -> DataFrame:
    """The rows that ``browse.search`` finds, with an index that ``build_index`` made of them."""
    some = candidates(spark, path, query)
    if some is not None:
        rows = rows.join(some.withColumnRenamed("id", "__id"), F.col(row_id) == F.col("__id"), "left_semi")
    return rows.where(search_condition(query, columns))
