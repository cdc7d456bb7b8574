"""Removal of repeated passages by compacting the de Bruijn graph of word windows.

The edges of the graph are windows of ``width`` words; the nodes between them the ``width - 1`` words that two
successive windows share. Only edges that occur in several texts matter:

1. Each window is represented by its minimizer, the run of ``SEED_WORDS`` words in it with the smallest
   hash. Equal windows have equal minimizers, so an edge can only repeat where its minimizer does;
   this leaves a fraction of all windows.
2. The windows left are edges with 128-bit keys. Each gets its source, a document with a smaller id in
   which it starts too, if there is one. A task compares its own edges first and sends on one row for
   each, so a passage in a third of all documents is no hot key.
3. Successive edges of a document with the same source are a nonbranching path; each path is compacted to one
   row of coordinates: where it starts, how many edges it has, its source.
4. The words of all paths whose source is another, smaller document are removed.

Texts are handled once: rows with equal texts share their edges, and all but those of the smallest
id are copies as a whole. Joins that carry texts use the text's key and the id together, so a large group
of copies is spread; texts are compressed before.

A null or empty text has no words and nothing is removed. A null id counts as larger than any other. Rows
with equal ids are never smaller than one another; each has its own result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.llm.words import Out, WordHashes, gram_hashes, mixed, rows_of, spaced_words
from duelens.operators.staging import staged

SEED_WORDS = 6
_LAST_ID = (1 << 63) - 1
_SEEN_TEXTS = 100_000
_OTHER = np.uint64(0x5851F42D4C957F2D)
#: Rows a task gathers before it compares them among themselves and sends them on.
_HELD_ROWS = 100_000


def _minimizers(grams: np.ndarray, many: int) -> np.ndarray:
    """For each run of ``many`` grams the smallest."""
    return np.lib.stride_tricks.sliding_window_view(grams, many).min(axis=1)


_TEXTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("id", pa.int64()),
        ("text_key", pa.int64()),
        ("packed", pa.binary()),
    ]
)


def _pack_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress texts before they are shuffled."""
    out, packer = Out(_TEXTS), zstandard.ZstdCompressor(level=1)
    for doc_id, known_id, key, text in rows_of(batches):
        packed = packer.compress(text.encode("utf-8", "surrogatepass"))
        if out.add(doc_id, known_id, key, packed, size=len(packed)):
            yield out.batch()
    yield out.batch()


def _packed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "id", "text_key", "text").mapInArrow(
        _pack_rows, "doc_id long, id long, text_key long, packed binary"
    )


def _starts(*ordered: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted arrays."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for values in ordered:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _seed_batch(seeds: list[np.ndarray], keys: list[np.ndarray], schema: pa.Schema):
    """What a task asks and what it knows by itself.

    A seed in several texts of the task repeats for certain: those rows carry a place of their own and
    pass through. For each seed only two rows at most (place 0) are left to be compared with those of
    other tasks, however many texts have it.
    """
    seed, key = np.concatenate(seeds), np.concatenate(keys)
    order = np.lexsort((key, seed))
    seed, key = seed[order], key[order]
    first = _starts(seed)
    many = np.diff(np.r_[first, len(seed)])
    size = np.repeat(many, many)
    number = np.arange(len(seed)) - np.repeat(first, many)
    asked = number < 2
    known = size > 1
    place = np.r_[np.zeros(asked.sum(), np.int64), key[known] | 1]
    columns = [np.r_[seed[asked], seed[known]], np.r_[key[asked], key[known]], place]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def _seeds(width: int) -> Callable:
    """(text key, text) -> (minimizer, text key, place)."""
    schema = pa.schema([("seed", pa.int64()), ("text_key", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        keys, seeds, held = [], [], 0
        for key, text in rows_of(batches):
            if key in seen:
                continue
            if len(seen) < _SEEN_TEXTS:
                seen.add(key)
            words = spaced_words(text)
            if len(words) < width:
                continue
            grams = gram_hashes(hashes.of(words), min(SEED_WORDS, width))
            found = np.unique(_minimizers(grams, width - min(SEED_WORDS, width) + 1))
            seeds.append(found.view(np.int64))
            keys.append(np.full(len(found), key, np.int64))
            held += len(found)
            if held > _HELD_ROWS:
                yield _seed_batch(seeds, keys, schema)
                keys, seeds, held = [], [], 0
        if held:
            yield _seed_batch(seeds, keys, schema)

    return run


_EDGES = pa.schema(
    [
        ("h1", pa.int64()),
        ("h2", pa.int64()),
        ("owner", pa.int64()),
        ("source", pa.int64()),
        ("places", pa.list_(pa.int64())),
    ]
)


def _edge_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Edges of a task: one row for each edge and document, with all places in it.

    The smallest document of an edge is asked for (``source`` is null). For the others a smaller one is
    known already; their rows get keys of their own and pass through, so a passage that very many
    documents share is as many rows under one key as there are tasks.
    """
    h1, h2, owner, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((place, owner, h2, h1))
    h1, h2, owner, place = h1[order], h2[order], owner[order], place[order]
    rows = _starts(h1, h2, owner)
    edges = _starts(h1[rows], h2[rows])
    many = np.diff(np.r_[edges, len(rows)])
    source = np.repeat(owner[rows][edges], many)
    known = source != owner[rows]
    offsets = np.r_[rows, len(place)].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(known, owner[rows], h1[rows])),
            pa.array(np.where(known, place[rows], h2[rows])),
            pa.array(owner[rows]),
            pa.array(source, mask=~known),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(place)),
        ],
        schema=_EDGES,
    )


def _edge_rows(width: int) -> Callable:
    """(owner, number, packed text, seeds) -> the windows with such a minimizer, by window.

    A place is the text's number among the texts of its id, times 2 ** 32, plus the word.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, unpacker = WordHashes(), zstandard.ZstdDecompressor()
        parts, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                owner, number, packed, seeds = (c[i] for c in batch.columns)
                words = unpacker.decompress(packed.as_py()).split()
                hashes = memo.of(words)
                grams = gram_hashes(hashes, min(SEED_WORDS, width))
                of_windows = _minimizers(grams, width - min(SEED_WORDS, width) + 1)
                wanted = np.sort(seeds.values.to_numpy().view(np.uint64))
                at = np.minimum(np.searchsorted(wanted, of_windows), len(wanted) - 1)
                places = np.flatnonzero(wanted[at] == of_windows)
                h1 = gram_hashes(hashes, width)[places].view(np.int64)
                h2 = gram_hashes(mixed(hashes ^ _OTHER), width)[places].view(np.int64)
                places = places + (number.as_py() << 32)
                parts.append((h1, h2, np.full(len(places), owner.as_py(), np.int64), places))
                held += len(places)
                if held > _HELD_ROWS:
                    yield _edge_batch(parts)
                    parts, held = [], 0
        if held:
            yield _edge_batch(parts)

    return run


def _kept_rows(width: int) -> Callable:
    """(doc_id, packed text, is a copy, spans) -> what is left."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("kept_sha256", pa.string()),
            ("kept", pa.string()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, unpacker = Out(schema), zstandard.ZstdDecompressor()
        for doc_id, packed, copied, spans in rows_of(batches):
            words = unpacker.decompress(packed).split()
            if copied and len(words) >= width:
                kept = []
            elif spans:
                gone = np.zeros(len(words) + 1, np.int32)
                for span in spans:
                    gone[span["start"]] += 1
                    gone[span["end"]] -= 1
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                kept = [words[i] for i in left.tolist()]
            else:
                kept = words
            joined = b" ".join(kept)
            digest = hashlib.sha256(joined).hexdigest()
            row = (doc_id, len(words), len(words) - len(kept), digest, joined.decode("utf-8"))
            if out.add(*row, size=len(joined)):
                yield out.batch()
        yield out.batch()

    return run


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("id"),
        F.xxhash64(F.unhex(F.md5(text))).alias("text_key"),
        text.alias("text"),
    )


def repeated_paths(docs: DataFrame, width: int = 13) -> tuple[DataFrame, DataFrame]:
    """(owners, paths).

    Owners are (text_key, owner, number): the smallest id of each text, and the text's number among those of
    that id. Paths are (owner, number, start, edges, source): ``edges`` successive windows from word
    ``start`` on, all of which start in ``source``.
    """
    rows = _rows(docs)
    owners = staged(
        rows.groupBy("text_key")
        .agg(F.min("id").alias("owner"))
        .selectExpr(
            "text_key",
            "owner",
            "row_number() OVER (PARTITION BY owner ORDER BY text_key) - 1L AS number",
        )
    )
    wanted = staged(
        rows.select("text_key", "text")
        .mapInArrow(_seeds(width), "seed long, text_key long, place long")
        .selectExpr(
            "*",
            "min(text_key) OVER (PARTITION BY seed, place) AS low",
            "max(text_key) OVER (PARTITION BY seed, place) AS high",
        )
        .where("place <> 0 OR low < high")
        .groupBy("text_key")
        .agg(F.collect_set("seed").alias("seeds"))
    )
    chosen = owners.join(wanted, "text_key").withColumnRenamed("text_key", "chosen_key")
    paths = (
        _packed(rows)
        .join(
            chosen, (F.col("text_key") == F.col("chosen_key")) & (F.col("id") == F.col("owner"))
        )
        .select("owner", "number", "packed", "seeds")
        .mapInArrow(
            _edge_rows(width),
            "h1 long, h2 long, owner long, source long, places array<long>",
        )
        .selectExpr(
            "owner",
            "coalesce(source, min(owner) OVER (PARTITION BY h1, h2)) AS source",
            "places",
        )
        .where("source < owner")
        .select("owner", "source", F.explode("places").alias("at"))
        .selectExpr(
            "*",
            "at - dense_rank() OVER (PARTITION BY owner, source ORDER BY at) AS path",
        )
        .groupBy("owner", "source", "path")
        .agg(F.min("at").alias("at"), (F.max("at") - F.min("at") + 1).alias("edges"))
        .selectExpr(
            "owner", "at DIV 4294967296 AS number", "at % 4294967296 AS start", "edges", "source"
        )
    )
    return owners, paths


def without_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row of ``docs`` (doc_id, text).

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id.
    """
    owners, paths = repeated_paths(docs, width)
    span = F.struct(
        F.col("start").cast("int").alias("start"),
        (F.col("start") + F.col("edges") + width - 1).cast("int").alias("end"),
    )
    spans = paths.groupBy("owner", "number").agg(F.collect_list(span).alias("spans"))
    known = owners.join(spans, ["owner", "number"], "left").select(
        F.col("text_key").alias("known_key"), "owner", "spans"
    )
    return (
        _packed(_rows(docs))
        .join(
            known,
            (F.col("text_key") == F.col("known_key")) & (F.col("id") == F.col("owner")),
            "left",
        )
        .select("doc_id", "packed", F.isnull("known_key").alias("copied"), "spans")
        .mapInArrow(
            _kept_rows(width),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string",
        )
    )
