"""Vectors as whole numbers inside tasks, and exact sums of them over all tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
LAST_LONG = (1 << 63) - 1
#: Components up to here are 64-bit numbers in numpy; larger ones are Python's whole numbers.
SMALL = 1 << 23
#: Sums are shuffled as ``high * PART + low``, so that sums of any 32-bit floats fit.
PART = 10**20
_SUMS = pa.schema(
    [
        ("owner", pa.int32()),
        ("place", pa.int32()),
        ("high", pa.decimal128(38, 0)),
        ("low", pa.decimal128(38, 0)),
    ]
)
SUM_TYPES = "owner int, place int, high decimal(38,0), low decimal(38,0)"


def _whole(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), exactly; an array of Python's whole numbers if any is too large."""
    if values.size and np.abs(values).max() >= SMALL // SCALE:
        return np.array([_whole(x) for x in values.ravel()], object).reshape(values.shape)
    return np.floor(values * float(SCALE)).astype(np.int64)


def valid_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components as doubles) of the vectors of ``width`` finite components."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy() == width)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), width)
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def first_vectors(
    table: DataFrame, width: int, many: int, mark: Callable[[int], object], kind: str
) -> np.ndarray:
    """The ``many`` valid vectors with the smallest ``mark(vec_id)`` (of Spark type ``kind``), in that
    order; ties by their components. Rows without an id are none of them.

    Each task keeps no more than ``many``; the driver gets no more than ``many`` either.
    """
    arrow = {"string": pa.string(), "long": pa.int64()}[kind]
    schema = pa.schema([("mark", arrow), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            rows, values = valid_vectors(batch.column(1), width)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            found = [(mark(i), at) for at, i in enumerate(ids) if i is not None]
            if len(found) > 4 * many:
                last = sorted(m for m, _ in found)[many - 1]
                found = [(m, at) for m, at in found if m <= last]
            best = sorted(best + [(m, values[at].tolist()) for m, at in found])[:many]
        columns = list(zip(*best, strict=True)) or [[], []]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    found = (
        table.select(F.col("vec_id").cast("long"), "embedding")
        .mapInArrow(run, f"mark {kind}, vector array<double>")
        .orderBy("mark", "vector")
        .limit(many)
        .collect()
    )
    return np.array([r.vector for r in found], np.float64).reshape(len(found), width)


def sum_rows(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(owner, place, high, low) of the sums (owners, places) of a task; place -1 has the counts."""
    used = np.flatnonzero(counts)
    columns: list[list] = [[], [], [], []]
    for owner in used:
        for place, value in enumerate([int(counts[owner]), *map(int, sums[owner])], -1):
            high, low = divmod(value, PART)
            for column, item in zip(
                columns, (int(owner), place, Decimal(high), Decimal(low)), strict=True
            ):
                column.append(item)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _SUMS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_SUMS)


def floor_means(parts: DataFrame, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each owner, from the rows of ``sum_rows``; owners without rows stay as in ``old``.

    Only one row for each owner and place, whatever the number of vectors, reaches the driver.
    """
    total = parts.groupBy("owner", "place").agg(F.sum("high").alias("h"), F.sum("low").alias("l"))
    found = {(r.owner, r.place): int(r.h) * PART + int(r.l) for r in total.collect()}
    new = old.astype(object)
    for (owner, place), value in found.items():
        if place >= 0:
            new[owner, place] = value // found[owner, -1]
    return packed(new)


def packed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers where all are small enough."""
    small = all(abs(int(v)) <= SMALL for v in values.ravel())
    return values.astype(np.int64) if small else values


def long_or_last(values: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; what is larger becomes the largest of them."""
    return np.minimum(values, LAST_LONG).astype(np.int64)
