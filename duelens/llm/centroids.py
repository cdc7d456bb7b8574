"""Centroid clustering with a progressive search in the Walsh-Hadamard domain.

Vectors of 64 whole numbers and the centroids are transformed exactly (additions only). The transform keeps
squared distances up to the factor 64, so the squared differences of some coefficients are a lower
bound of the whole. A search adds them up from coarse coefficients (few sign changes) to fine ones: after
the first few, the most promising centroid is measured in full; centroids already farther than
that are strictly worse and go, and the search goes on with the rest, block by block, until
all 64 coefficients of what is left are added. Ties go to the smaller number.

Each round is one pass over the vectors. A task sends one row for each centroid and component, so what is
shuffled and what the driver sees does not grow with the vectors of a cluster, and a cluster that holds
most vectors is no hot key.

Null vectors, vectors of another length and vectors with null or non-finite components have no row. Vectors
without an id are clustered but are no starts; rows that share an id are vectors of their own, ties between
starts are settled by the components. With fewer vectors than centroids there are fewer centroids; an empty
table has no rows, nor has a table in which no vector has an id. Sums are exact at any size; a distance or an inertia beyond the long type is given
as the largest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.llm import vectors
from duelens.operators.staging import staged

WIDTH = 64
#: Ends of the blocks of coefficients that are added in turn.
BLOCKS = (4, 8, 16, 32, WIDTH)
_ROWS_AT_ONCE = 4096


def _sequency() -> np.ndarray:
    """Places of the coefficients of ``_butterflies``, from no change of sign to 63 of them."""
    rows = _butterflies(np.eye(WIDTH, dtype=np.int64))
    return np.argsort(np.count_nonzero(np.diff(rows, axis=0), axis=0), kind="stable")


def _butterflies(rows: np.ndarray) -> np.ndarray:
    step = 1
    while step < WIDTH:
        pairs = rows.reshape(len(rows), -1, 2, step)
        left, right = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([left + right, left - right], axis=2).reshape(len(rows), WIDTH)
        step *= 2
    return rows


_ORDER = _sequency()


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """The exact transform of rows of 64 whole numbers, coarse coefficients first."""
    return _butterflies(rows)[:, _ORDER]


def _squares(differences: np.ndarray) -> np.ndarray:
    return (differences * differences).sum(axis=-1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row; both sides are transformed vectors."""
    if rows.dtype == object or centroids.dtype == object:
        rows, centroids = rows.astype(object), centroids.astype(object)
    first = BLOCKS[0]
    seen = _squares(rows[:, None, :first] - centroids[None, :, :first])
    guess = seen.argmin(axis=1)
    bound = _squares(rows - centroids[guess])
    row, centroid = np.nonzero(seen <= bound[:, None])
    seen = seen[row, centroid]
    for start, end in zip(BLOCKS, BLOCKS[1:], strict=False):
        seen = seen + _squares(rows[row, start:end] - centroids[centroid, start:end])
        left = seen <= bound[row]
        row, centroid, seen = row[left], centroid[left], seen[left]
    starts = np.searchsorted(row, np.arange(len(rows)))
    least = np.minimum.reduceat(seen, starts)
    ties = np.flatnonzero(seen == least[row])
    best = ties[np.searchsorted(row[ties], np.arange(len(rows)))]
    return centroid[best], least // WIDTH


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, whole numbers) of the valid vectors, a bounded number at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            part = batch.slice(at, _ROWS_AT_ONCE)
            rows, values = vectors.valid_vectors(part.column(1), WIDTH)
            if len(rows):
                yield part.column(0).take(pa.array(rows)), vectors.whole_numbers(values)


def _round(centroids: np.ndarray):
    coarse = walsh_hadamard(centroids)

    def run(batches):
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, object)
        for _, values in _parts(batches):
            found, _ = nearest(walsh_hadamard(values), coarse)
            counts += np.bincount(found, minlength=len(centroids))
            order = np.argsort(found, kind="stable")
            used, starts = np.unique(found[order], return_index=True)
            sums[used] += np.add.reduceat(values[order], starts, axis=0).astype(object)
        yield vectors.sum_rows(sums, counts)

    return run


def _assigned(centroids: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    coarse = walsh_hadamard(centroids)

    def run(batches):
        for ids, values in _parts(batches):
            found, distance = nearest(walsh_hadamard(values), coarse)
            arrays = [
                ids,
                pa.array(found.astype(np.int32)),
                pa.array(vectors.long_or_last(distance)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def starts(table: DataFrame, many: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""

    def mark(vec_id: int) -> str:
        return hashlib.sha256(f"{seed}:{vec_id}".encode()).hexdigest()

    return vectors.whole_numbers(vectors.first_vectors(table, WIDTH, many, mark, "string"))


def fitted(table: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after ``rounds`` of assignment and replacement by componentwise floor(mean)."""
    rows = table.select(F.col("vec_id").cast("long"), "embedding")
    for _ in range(rounds if len(centroids) else 0):
        parts = rows.mapInArrow(_round(centroids), vectors.SUM_TYPES)
        centroids = vectors.floor_means(parts, centroids)
    return centroids


def clusters(table: DataFrame, many: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``table`` (vec_id, embedding)."""
    spark = table.sparkSession
    centroids = fitted(table, starts(table, many, seed), rounds)
    kind = "vec_id long, cluster int, distance long"
    if not len(centroids):
        rows = spark.createDataFrame([], kind)
    else:
        rows = staged(
            table.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
                _assigned(centroids), kind
            )
        )
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")
    sums = {r.cluster: int(r.sum) for r in rows.groupBy("cluster").agg(exact).collect()}
    total = min(sum(sums.values()), vectors.LAST_LONG)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [
        (c, min(s, vectors.LAST_LONG), total, hashes[c]) for c, s in sorted(sums.items())
    ]
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # One row for each centroid.
    return rows.join(F.broadcast(spark.createDataFrame(facts, names)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
