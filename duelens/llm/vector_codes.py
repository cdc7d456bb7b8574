"""Product codes of vectors, by Lloyd's rounds over two trees.

Vectors are cut into equal parts, and each part position has a codebook of its own. In a task, the parts of a batch form
a balanced tree (nodes split in half along their widest side) whose nodes know their bounding box, their
number of parts and the sum of them; the entries of a codebook form another tree, made once a round. Pairs of
nodes go down both trees together. The box distances of a pair bound the distances of everything in
them: entry nodes farther from a part node than the largest distance to another entry node are pruned (ties
stay). A part node with one entry left is assigned whole, with its cached sum; parts of leaves with
several entries left are measured one by one in whole numbers, ties to the lower index.

Each round is one pass over the vectors; a task sends one row for each entry and component. So neither an entry that
most parts share nor a hot label gathers rows in one task.

Null vectors and vectors with null or non-finite components have no row. Vectors must be of one length that the number of
parts divides: the length most vectors have (ties: the longer one); others have no row either. Vectors
without an id are coded but are no starts; rows that share an id are vectors of their own, ties between
starts are settled by the components. With fewer vectors than entries there are fewer entries; an
empty table has no rows, nor has a table in which no vector has an id. Sums are exact at any size; an error beyond the long type is
given as the largest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from duelens.llm import vectors
from duelens.operators.lookup import salted_join
from duelens.operators.staging import staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Parts of a leaf of the part tree, at most.
LEAF = 12
#: Pairs of a leaf and an entry that are measured at once.
_PAIRS_AT_ONCE = 20_000


class EntryLevel(NamedTuple):
    """One level of an entry tree: boxes, the two children of each node (equal where it is one entry), and
    the entry of a node that holds only one."""

    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    entry: np.ndarray


def entry_tree(entries: np.ndarray) -> list[EntryLevel]:
    """Levels of the tree over the entries, from the root to single entries."""
    levels, nodes = [], [np.arange(len(entries))]
    while True:
        below: list[np.ndarray] = []
        children = []
        for node in nodes:
            if len(node) == 1:
                children.append((len(below), len(below)))
                below.append(node)
                continue
            values = entries[node]
            side = (values.max(axis=0) - values.min(axis=0)).argmax()
            order = node[np.argsort(values[:, side], kind="stable")]
            children.append((len(below), len(below) + 1))
            below += [order[: len(order) // 2], order[len(order) // 2 :]]
        levels.append(
            EntryLevel(
                np.stack([entries[n].min(axis=0) for n in nodes]),
                np.stack([entries[n].max(axis=0) for n in nodes]),
                np.array(children),
                np.array([n[0] for n in nodes]),
            )
        )
        if all(len(n) == 1 for n in nodes):
            return levels
        nodes = below


class PartLevel(NamedTuple):
    """One level of a part tree: boxes, numbers and sums of the parts of each node."""

    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray
    sums: np.ndarray


def part_tree(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[PartLevel]]:
    """(places, counted, levels): a node of a level has an equal share of ``places``, in order.

    The places are filled up with the first part; ``counted`` is 0 there.
    """
    many, depth = len(parts), 0
    while many > LEAF << depth:
        depth += 1
    leaf = -(-many // (1 << depth))
    places = np.zeros(leaf << depth, np.int64)
    places[:many] = np.arange(many)
    counted = np.zeros(len(places), np.int64)
    counted[:many] = 1
    boxes = []
    for level in range(depth + 1):
        nodes = places.reshape(1 << level, -1)
        values = parts[nodes]
        low, high = values.min(axis=1), values.max(axis=1)
        boxes.append((low, high))
        if level < depth:
            side = (high - low).argmax(axis=1)
            keys = np.take_along_axis(values, side[:, None, None], axis=2)[:, :, 0]
            order = np.argsort(keys, axis=1, kind="stable")
            places = np.take_along_axis(nodes, order, axis=1).ravel()
            counted = np.take_along_axis(counted.reshape(nodes.shape), order, axis=1).ravel()
    leaves = (1 << depth, leaf)
    counts = counted.reshape(leaves).sum(axis=1)
    sums = (parts[places] * counted[:, None]).reshape(*leaves, -1).sum(axis=1)
    levels = []
    for low, high in reversed(boxes):
        levels.append(PartLevel(low, high, counts, sums))
        if len(counts) > 1:
            counts, sums = counts[::2] + counts[1::2], sums[::2] + sums[1::2]
    return places, counted, levels[::-1]


def _bounds(part: PartLevel, entry: EntryLevel, p: np.ndarray, e: np.ndarray) -> tuple:
    """The smallest and the largest squared distance the boxes of node pairs allow."""
    above, below = entry.high[e] - part.low[p], part.high[p] - entry.low[e]
    near = np.maximum(np.maximum(-above, -below), 0)
    far = np.maximum(above, below)
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def assigned(
    parts: np.ndarray, entries: np.ndarray, tree: list[EntryLevel]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each part, number and sum of the parts of each entry)."""
    places, counted, levels = part_tree(parts)
    found = np.zeros(len(parts), np.int64)
    counts = np.zeros(len(entries), np.int64)
    sums = np.zeros(entries.shape, parts.dtype)
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = last = 0
    while True:
        near, far = _bounds(levels[depth], tree[last], p, e)
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        many = np.diff(starts, append=len(p))
        kept = near <= np.repeat(np.minimum.reduceat(far, starts), many)
        p, e = p[kept], e[kept]
        single = last == len(tree) - 1
        if single:
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            alone = np.diff(starts, append=len(p)) == 1
            nodes, chosen = p[starts[alone]], tree[last].entry[e[starts[alone]]]
            found[places.reshape(1 << depth, -1)[nodes]] = chosen[:, None]
            np.add.at(counts, chosen, levels[depth].counts[nodes])
            np.add.at(sums, chosen, levels[depth].sums[nodes])
            rest = np.repeat(~alone, np.diff(starts, append=len(p)))
            p, e = p[rest], e[rest]
            if not len(p):
                return found, counts, sums
            if depth == len(levels) - 1:
                break
        if not single:
            p, e = _children(p, e, tree[last].children)
            last += 1
        if depth < len(levels) - 1:
            # Both halves of a part node get all its entry nodes; node pairs stay in order of the part node.
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            many = np.diff(starts, append=len(p))
            twice = np.repeat(many, 2)
            at = np.arange(twice.sum()) - np.repeat(np.cumsum(twice) - twice, twice)
            e = e[np.repeat(np.repeat(starts, 2), twice) + at]
            p = np.repeat(np.stack([2 * p[starts], 2 * p[starts] + 1], axis=1).ravel(), twice)
            depth += 1
    nodes, chosen, slots = _measured(
        parts, entries, places.reshape(1 << depth, -1), p, tree[last].entry[e]
    )
    found[slots] = chosen
    held = counted.reshape(len(levels[depth].counts), -1)[nodes].ravel()
    np.add.at(counts, chosen, held)
    np.add.at(sums, chosen, parts[slots] * held[:, None])
    return found, counts, sums


def _measured(
    parts: np.ndarray, entries: np.ndarray, places: np.ndarray, p: np.ndarray, e: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves, entries, places) of uncertain leaves: the nearest of its candidates for each place."""
    starts = np.flatnonzero(np.diff(p, prepend=-1))
    slots = places[p[starts]]
    nearest = []
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(p), _PAIRS_AT_ONCE)))
    cuts = cuts[cuts < len(starts)]  # none begins behind the first pair of the last leaf
    for first, end in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        begin, stop = starts[first], starts[end] if end < len(starts) else len(p)
        many = np.diff(starts[first:end], append=stop)
        apart = parts[np.repeat(slots[first:end], many, axis=0)] - entries[e[begin:stop], None]
        keys = (apart * apart).sum(axis=2) * len(entries) + e[begin:stop, None]
        nearest.append(np.minimum.reduceat(keys, starts[first:end] - begin, axis=0) % len(entries))
    chosen = np.concatenate(nearest).astype(np.int64)
    return p[starts], chosen.ravel(), slots.ravel()


def _children(p: np.ndarray, e: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = children[e]
    two = pairs[:, 0] != pairs[:, 1]
    times = 1 + two
    p = np.repeat(p, times)
    second = np.cumsum(times)[two] - 1
    e = np.repeat(pairs[:, 0], times)
    e[second] = pairs[two, 1]
    return p, e


def _safe(values: np.ndarray, books: np.ndarray) -> bool:
    """Whether squared distances, times the number of entries, are 64-bit numbers."""
    if values.dtype == object or books.dtype == object:
        return False
    most = max(int(np.abs(values).max()), int(np.abs(books).max()))
    return books.shape[2] * (2 * most) ** 2 * books.shape[1] < 1 << 62


def _coded(batches: Iterable[pa.RecordBatch], width: int, books: np.ndarray) -> Iterator[tuple]:
    """(batch of the valid rows, values, codes, errors, counts, sums) of each batch.

    ``books`` (positions, entries, components) are the codebooks.
    """
    trees = [entry_tree(b) for b in books]
    n_parts, n_entries, size = books.shape
    for batch in batches:
        rows, values = vectors.valid_vectors(batch.column(1), width)
        if not len(rows):
            continue
        values = vectors.whole_numbers(values)
        codebooks, indexes = books, trees
        if not _safe(values, books):
            values, codebooks = values.astype(object), books.astype(object)
            indexes = [entry_tree(b) for b in codebooks]
        codes = np.empty((len(rows), n_parts), np.uint8)
        errors = np.zeros(len(rows), values.dtype)
        counts = np.empty((n_parts, n_entries), np.int64)
        sums = np.empty(books.shape, values.dtype)
        for n in range(n_parts):
            parts = np.ascontiguousarray(values[:, n * size : (n + 1) * size])
            found, counts[n], sums[n] = assigned(parts, codebooks[n], indexes[n])
            codes[:, n] = found
            apart = parts - codebooks[n][found]
            errors += (apart * apart).sum(axis=1)
        yield batch.take(pa.array(rows)), codes, errors, counts, sums


def _round(width: int, books: np.ndarray):
    def run(batches):
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object)
        for _, _, _, more, added in _coded(batches, width, books):
            counts += more
            sums += added.astype(object)
        yield vectors.sum_rows(sums.reshape(-1, books.shape[2]), counts.ravel())

    return run


def _final(width: int, books: np.ndarray, label: pa.DataType):
    schema = pa.schema(
        [("vec_id", pa.int64()), ("label", label), ("code", pa.string()), ("error", pa.int64())]
    )

    def run(batches):
        for batch, codes, errors, _, _ in _coded(batches, width, books):
            digits, step = codes.tobytes().hex(), 2 * codes.shape[1]
            text = [digits[i : i + step] for i in range(0, len(digits), step)]
            arrays = [
                batch.column(0),
                batch.column(2).cast(label),
                pa.array(text, pa.string()),
                pa.array(vectors.long_or_last(errors)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def common_length(table: DataFrame, parts: int) -> int:
    """The length of most vectors among those that ``parts`` divides; 0 without any."""
    sizes = table.select(F.size("embedding").alias("n")).where(f"n > 0 AND n % {parts} = 0")
    first = sizes.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    return first.n if first else 0


def codebooks(
    table: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray:
    """(positions, entries, components) after ``rounds``; entries no part is nearest to stay as they are."""
    begin = vectors.first_vectors(table, width, entries, int, "long")
    whole = vectors.whole_numbers(begin)
    books = np.ascontiguousarray(whole.reshape(len(whole), parts, width // parts).swapaxes(0, 1))
    for _ in range(rounds if len(whole) else 0):
        sums = table.mapInArrow(_round(width, books), vectors.SUM_TYPES)
        flat = books.reshape(-1, books.shape[2])
        books = vectors.floor_means(sums, flat).reshape(books.shape)
    return books


def codes(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``table`` (vec_id, embedding, label).

    At most 256 entries: a code has two hex digits a part.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    width = common_length(rows, parts)
    books = codebooks(rows, width, parts, entries, rounds) if width else np.empty((parts, 0, 0))
    text = ",".join(str(x) for x in books.ravel().tolist())
    digest = hashlib.sha256(text.encode()).hexdigest()
    label = rows.schema["label"].dataType
    kind = f"vec_id long, label {label.simpleString()}, code string, error long"
    if books.shape[1]:
        run = _final(width, books, to_arrow_type(label))
        coded = staged(rows.mapInArrow(run, kind))
    else:
        coded = table.sparkSession.createDataFrame([], kind)
    # Null labels are one label; a hot label is spread over many tasks.
    named = coded.withColumn("no_label", F.col("label").isNull()).withColumn(
        "same_label", F.coalesce(F.col("label").cast("string"), F.lit(""))
    )
    keys = ["same_label", "no_label"]
    most = F.lit(vectors.LAST_LONG).cast("decimal(38,0)")
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long")
    sums = named.groupBy(*keys).agg(exact.alias("label_error"))
    return salted_join(named, sums, keys, ["vec_id", "code"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
