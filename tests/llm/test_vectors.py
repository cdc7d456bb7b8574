"""Codes and clusters of vectors against plain loops over all pairs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelens.llm import centroids, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, owner int, cluster int, mark int"


def whole(vector) -> list[int]:
    return [int(np.floor(np.float64(np.float32(x)) * 256)) for x in vector]


def distance(x, y) -> int:
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def lloyd(rows: list[list[int]], start: list[list[int]], rounds: int):
    """(final entries, index of each row) by comparing everything with everything."""
    entries = [list(e) for e in start]

    def nearest():
        return [min(range(len(entries)), key=lambda i: (distance(r, entries[i]), i)) for r in rows]

    for _ in range(rounds):
        found = nearest()
        for i in set(found):
            held = [r for r, f in zip(rows, found, strict=True) if f == i]
            entries[i] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    return entries, nearest()


def fine(vector, width: int) -> bool:
    return vector is not None and len(vector) == width and all(
        x is not None and np.isfinite(np.float32(x)) for x in vector
    )


def digest(numbers) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def plain_clusters(rows, many=40, rounds=5, seed=2):
    kept = [(i, whole(v)) for i, v, _ in rows if fine(v, 64)]
    marks = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    entries, found = lloyd([v for _, v in kept], [v for _, v in marks[:many]], rounds)
    apart = [distance(v, entries[f]) for (_, v), f in zip(kept, found, strict=True)]
    sums = [sum(d for d, f in zip(apart, found, strict=True) if f == c) for c in range(len(entries))]
    return [
        (i, f, d, sums[f], sum(apart), digest(entries[f]))
        for (i, _), f, d in zip(kept, found, apart, strict=True)
    ]


def plain_codes(rows, width, parts=16, many=64, rounds=2):
    kept = [(i, whole(v), label) for i, v, label in rows if fine(v, width)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:many]
    size, books, codes, errors = width // parts, [], [""] * len(kept), [0] * len(kept)
    for p in range(parts):
        part = [v[p * size : (p + 1) * size] for _, v, _ in kept]
        entries, found = lloyd(part, [v[p * size : (p + 1) * size] for _, v in first], rounds)
        books += [x for e in entries for x in e]
        for n, f in enumerate(found):
            codes[n] += f"{f:02x}"
            errors[n] += distance(part[n], entries[f])
    sums: dict = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    return [
        (i, c, e, sums[label], digest(books))
        for (i, _, label), c, e in zip(kept, codes, errors, strict=True)
    ]


def frame(spark, rows):
    clash = [(i, v, label, "x", 1, 2, 3) for i, v, label in rows]
    return spark.createDataFrame(clash, SCHEMA).repartition(3)


def found(table) -> list:
    return sorted((tuple(r) for r in table.collect()), key=repr)


def awkward_rows(width: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (90, width)).astype(np.float32).tolist()
    rows = [(int(i * 7 % 101), v, int(i % 4) if i % 5 else None) for i, v in enumerate(base)]
    rows += [(500 + i, base[0], 1) for i in range(40)]
    rows += [(None, base[3], 2), (None, None, None), (7, base[5], 3), (7, base[6], 3), (900, None, 1)]
    rows += [(901, [], 1), (902, base[1][:-1], 1), (903, base[1] + [0.5], 1)]
    rows += [(904, [float("nan"), *base[1][1:]], 1), (905, [None, *base[1][1:]], 1)]
    rows += [(-3, [float("-inf"), *base[1][1:]], 1), (-9, [0.0] * width, None)]
    return rows


def test_clusters_of_awkward_rows(spark):
    rows = awkward_rows(64, 1)
    wanted = sorted(plain_clusters(rows), key=repr)
    assert found(centroids.clusters(frame(spark, rows))) == wanted
    few = [(3, [0.25] * 64, 1), (3, [0.25] * 64, 1), (4, [0.5] * 64, None)]
    assert found(centroids.clusters(frame(spark, few))) == sorted(plain_clusters(few), key=repr)
    for nothing in ([], [(1, None, 1), (2, [1.0], 2)]):
        empty = centroids.clusters(frame(spark, nothing))
        assert empty.count() == 0
        assert len(empty.columns) == 6


@pytest.mark.parametrize("width", [16, 64])
def test_codes_of_awkward_rows(spark, width):
    rows = awkward_rows(width, width)
    wanted = sorted(plain_codes(rows, width), key=repr)
    assert found(vector_codes.codes(frame(spark, rows))) == wanted
    few = [(3, [0.25] * width, 1), (3, [0.25] * width, 1), (4, [0.5] * width, None)]
    wanted = sorted(plain_codes(few, width), key=repr)
    assert found(vector_codes.codes(frame(spark, few))) == wanted
    for nothing in ([], [(1, None, 1), (2, [1.0], 2)]):
        empty = vector_codes.codes(frame(spark, nothing))
        assert empty.count() == 0
        assert len(empty.columns) == 5


def test_huge_components_are_exact(spark):
    rows = awkward_rows(64, 5) + [(-50, [3.0e7] * 64, 1), (-51, [-40000.0] + [0.0] * 63, 2)]
    assert found(vector_codes.codes(frame(spark, rows))) == sorted(plain_codes(rows, 64), key=repr)
    assert found(centroids.clusters(frame(spark, rows))) == sorted(plain_clusters(rows), key=repr)
    beyond = rows + [(-52, [3.0e38] * 64, 1)]
    last = centroids.clusters(frame(spark, beyond)).agg(F.max("inertia")).first()[0]
    assert last <= vectors.LAST_LONG
    assert vector_codes.codes(frame(spark, beyond)).count() == len(plain_codes(rows, 64)) + 1


def test_all_vectors_without_an_id(spark):
    rows = [(None, [0.5] * 64, 1), (None, [0.25] * 64, 2)]
    assert centroids.clusters(frame(spark, rows)).count() == 0
    assert vector_codes.codes(frame(spark, rows)).count() == 0


def test_transform_keeps_distances():
    rows = np.random.default_rng(2).integers(-300, 300, (50, 64))
    moved = centroids.walsh_hadamard(rows)
    assert ((moved[1:] - moved[:-1]) ** 2).sum(axis=1).tolist() == (
        64 * ((rows[1:] - rows[:-1]) ** 2).sum(axis=1)
    ).tolist()
    basis = centroids.walsh_hadamard(np.eye(64, dtype=np.int64))
    changes = np.count_nonzero(np.diff(basis, axis=0), axis=0)
    assert changes.tolist() == list(range(64))


@pytest.mark.parametrize("many", [1, 2, 12, 13, 25, 700])
@pytest.mark.parametrize("n_entries", [1, 2, 5, 64])
def test_two_trees_against_all_pairs(many, n_entries):
    rng = np.random.default_rng(many * n_entries)
    parts = rng.integers(-40, 40, (many, 4))
    parts[rng.random(many) < 0.3] = parts[0]
    entries = rng.integers(-40, 40, (n_entries, 4))
    entries[n_entries // 2] = entries[0]
    got, counts, sums = vector_codes.assigned(parts, entries, vector_codes.entry_tree(entries))
    apart = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    best = apart.argmin(axis=1)
    assert got.tolist() == best.tolist()
    assert counts.tolist() == np.bincount(best, minlength=n_entries).tolist()
    wanted = np.zeros_like(entries)
    np.add.at(wanted, best, parts)
    assert sums.tolist() == wanted.tolist()


@pytest.mark.parametrize("at_once", [1, 5, 100])
def test_a_last_leaf_with_more_pairs_than_are_measured_at_once(monkeypatch, at_once):
    monkeypatch.setattr(vector_codes, "_PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(at_once)
    parts, entries = rng.integers(-50, 50, (300, 4)), rng.integers(-50, 50, (64, 4))
    found, counts, sums = vector_codes.assigned(parts, entries, vector_codes.entry_tree(entries))
    nearest = ((parts[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(found, nearest)
    assert np.array_equal(counts, np.bincount(nearest, minlength=64))
    assert np.array_equal(sums, np.stack([parts[nearest == i].sum(axis=0) for i in range(64)]))
