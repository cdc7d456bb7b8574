"""Words and hashes of words inside tasks, and small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.operators.staging import discard, staged

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A-Z in lower case; of the other ASCII only digits and letters stay, so that split() gives words.
LETTERS = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32
    for b in range(256)
)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_spaced_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def letter_words(text: str | None) -> list[bytes]:
    """A-Z in lower case; runs of 0-9, a-z and everything outside ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words; forgets them all when it has grown too large."""

    def __init__(self, seed: int = 0, most: int = 100_000) -> None:
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a value reaches every bit of the result."""
    values = values ^ (values >> _SHIFT)
    values = values * _MIXER
    values = values ^ (values >> _SHIFT)
    values = values * _MIXER
    return values ^ (values >> _SHIFT)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; none where there are fewer words."""
    many = len(hashes) - width + 1
    if many <= 0:
        return np.empty(0, np.uint64)
    grams = hashes[:many]
    for step in range(1, width):
        grams = mixed(grams * _MULTIPLIER + hashes[step : step + many])
    return grams


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, one Python row at a time."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in columns)


class Out:
    """Gathers rows column by column and gives them back as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 20_000, size: int = 8_000_000) -> None:
        self.schema, self.rows, self.size = schema, rows, size
        self.columns: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, *row: object, size: int = 0) -> bool:
        """Take a row; true when the batch should be sent."""
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.held += size
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.held = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): (id, component), the smallest id of each.

    Large-star and small-star rounds in turn; every round is a few joins on the edge list,
    which shrinks to stars, and is written to the shared folder. Nodes without an edge have no row.
    """
    links = staged(edges.select("a", "b").where("a <> b").distinct())
    while not _stars(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a AND b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        old, links = links, staged(small)
        discard(old)
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which is the centre of its star, or none."""
    out = edges.select("a", (F.col("b") >= F.col("a")).cast("int").alias("up"), F.lit(1), F.lit(0))
    into = edges.select(F.col("b"), F.lit(0), F.lit(0), F.lit(1))
    wrong = (
        out.union(into)
        .toDF("a", "up", "n", "n_in")
        .groupBy("a")
        .agg(*(F.sum(c).alias(c) for c in ("up", "n", "n_in")))
        .where("up > 0 OR n > 1 OR (n > 0 AND n_in > 0)")
    )
    return wrong.isEmpty()
