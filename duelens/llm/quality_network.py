"""Quality scores from random-indexing word vectors and a small network.

Words are runs of letters and digits (A-Z in lower case) and runs of other signs between white space. Words share
``BUCKETS`` rows by their hash. Every row has a fixed index vector with a few random signs; the vector of a
row is the sum of the index vectors of all words within two places of its words, over all documents. The
sums are whole numbers, so partitions and lost executors leave no trace in them. Divided by the
number of occurrences, centred and brought to length 1, they are word vectors. A document is the mean of its word
vectors, frequent words counting less, and a few shares of its words.

The network (one hidden layer, numpy) learns from at most ``MOST_LABELLED`` labelled documents, those with the smallest hashes of their ids.
A fifth of the ids (crc32 of the id as text, modulo 5, is 0) is never learned from; another fifth (1) is
left out of the fit and sets the temperature that the scores are divided by. Everything else reads all documents:
the driver holds the table of rows (of fixed size), the bounded sample and the network.

A null or empty text has a pooled vector of zeros and is scored like any other; very long texts are read in pieces. A null
id is never learned from and counts as held out. Rows that share an id are scored one by one. A label that is null is
none; of several labels of an id the smallest counts. Without labels every score is 0.5, with labels of one kind
every score is their smoothed share. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.llm.words import LOWER, Out, WordHashes, rows_of

BUCKETS, DIMENSIONS, SIGNS, NEAR = 1 << 14, 32, 6, 2
MOST_LABELLED = 20_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 256, 0.01, 1e-3
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+")
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 20
_WORDS_AT_ONCE = 100_000
N_SHARES = 5


class RowHashes(WordHashes):
    """The row of a word in the table of vectors."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = zlib.crc32(word) % BUCKETS
        return value


class Doc(NamedTuple):
    """Rows of a text's words, in order, and how many of its bytes and words are special."""

    rows: np.ndarray
    n_bytes: int
    n_capitals: int
    n_signs: int


def read_text(text: str | None, rows: RowHashes) -> Doc:
    raw = (text or "").encode("utf-8", "surrogatepass")
    found, signs, start = [], 0, 0
    while start < len(raw):
        end = start + _PIECE
        gap = _SPACE.search(raw, end) if end < len(raw) else None
        end = gap.start() if gap else len(raw)
        words = _WORD.findall(raw[start:end].translate(LOWER))
        signs += sum(not (w[0] >= 128 or w[:1].isalnum()) for w in words)
        found.append(rows.of(words).astype(np.int32))
        start = end
    capitals = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    held = np.concatenate(found) if found else np.empty(0, np.int32)
    return Doc(held, len(raw), capitals, signs)


def index_vectors(seed: int = 1) -> np.ndarray:
    """(BUCKETS + 1, DIMENSIONS): ``SIGNS`` random signs in each row; none in the last, which is no word."""
    rng = np.random.default_rng(seed)
    places = rng.permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)[:, :SIGNS]
    vectors = np.zeros((BUCKETS + 1, DIMENSIONS), np.int32)
    signs = 1 - 2 * rng.integers(0, 2, places.shape, dtype=np.int32)
    np.put_along_axis(vectors[:BUCKETS], places, signs, axis=1)
    return vectors


def _add_contexts(rows: np.ndarray, last: int, index: np.ndarray, sums: np.ndarray) -> None:
    """Add the contexts of word pairs whose first word is before ``last``."""
    context = np.zeros((len(rows), DIMENSIONS), np.int32)
    for apart in range(1, NEAR + 1):
        many = min(last, len(rows) - apart)
        if many > 0:
            context[:many] += index[rows[apart : many + apart]]
            context[apart : many + apart] += index[rows[:many]]
    for place in range(DIMENSIONS):
        sums[:, place + 1] += np.bincount(
            rows, weights=context[:, place], minlength=len(sums)
        ).astype(np.int64)
    sums[:, 0] += np.bincount(rows[:last], minlength=len(sums))


_SUM_NAMES = ["n", *(f"c{i}" for i in range(DIMENSIONS))]


def _context_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """texts -> (row, occurrences, sums) of a task."""
    index, hashes = index_vectors(), RowHashes()
    sums = np.zeros((BUCKETS + 1, DIMENSIONS + 1), np.int64)
    gap = np.full(NEAR, BUCKETS, np.int32)
    held: list[np.ndarray] = []
    n_held = 0
    for (text,) in rows_of(batches):
        rows = read_text(text, hashes).rows
        while len(rows) > _WORDS_AT_ONCE:
            _add_contexts(rows[: _WORDS_AT_ONCE + NEAR], _WORDS_AT_ONCE, index, sums)
            rows = rows[_WORDS_AT_ONCE:]
        held += [rows, gap]
        n_held += len(rows) + NEAR
        if n_held > _WORDS_AT_ONCE:
            _add_contexts(np.concatenate(held), n_held, index, sums)
            held, n_held = [], 0
    if held:
        _add_contexts(np.concatenate(held), n_held, index, sums)
    used = np.flatnonzero(sums[:BUCKETS, 0])
    columns = [pa.array(used.astype(np.int32)), *(pa.array(c) for c in sums[used].T.copy())]
    yield pa.RecordBatch.from_arrays(columns, names=["row", *_SUM_NAMES])


class WordVectors(NamedTuple):
    vectors: np.ndarray
    weights: np.ndarray


def word_vectors(docs: DataFrame) -> WordVectors:
    """The vectors of all rows from all documents; frequent words weigh less.

    ``BUCKETS`` rows of sums are shuffled by each task and reach the driver, whatever the number of documents.
    """
    kinds = ", ".join(f"{name} long" for name in _SUM_NAMES)
    rows = (
        docs.select("text")
        .mapInArrow(_context_rows, f"row int, {kinds}")
        .groupBy("row")
        .agg(*(F.sum(name).alias(name) for name in _SUM_NAMES))
        .orderBy("row")
        .collect()
    )
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    weights = np.zeros(BUCKETS)
    if rows:
        held = np.array([tuple(r) for r in rows], np.int64)
        many = held[:, 1].astype(np.float64)
        total = many.sum()
        means = held[:, 2:] / many[:, None]
        means -= held[:, 2:].sum(axis=0) / total
        lengths = np.linalg.norm(means, axis=1, keepdims=True)
        vectors[held[:, 0]] = means / np.maximum(lengths, 1e-12)
        weights[held[:, 0]] = 1e-3 / (1e-3 + many / total)
    return WordVectors(vectors, weights)


def pooled(doc: Doc, words: WordVectors) -> np.ndarray:
    """The features of a document."""
    features = np.zeros(DIMENSIONS + N_SHARES)
    if not len(doc.rows):
        return features
    used, many = np.unique(doc.rows, return_counts=True)
    weights = many * words.weights[used]
    total = weights.sum()
    if total > 0:
        features[:DIMENSIONS] = weights @ words.vectors[used] / total
    n = len(doc.rows)
    features[DIMENSIONS:] = (
        np.log1p(n),
        np.log(len(used) / n),
        many.max() / n,
        doc.n_capitals / doc.n_bytes,
        doc.n_signs / n,
    )
    return features


class Network(NamedTuple):
    """Standardised features, one hidden layer, and the temperature of its odds."""

    mean: np.ndarray
    spread: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def odds(self, features: np.ndarray) -> np.ndarray:
        scaled = np.clip((features - self.mean) / self.spread, -8, 8)
        return np.tanh(scaled @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(features) / self.temperature, -60, 60)))


def constant_network(share: float) -> Network:
    """Gives every document the same score."""
    none, width = np.zeros(1), DIMENSIONS + N_SHARES
    log_odds = float(np.log(share / (1 - share)))
    return Network(
        np.zeros(width), np.ones(width), np.zeros((width, 1)), none, none, log_odds, 1.0
    )


def temperature_of(odds: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search on its logarithm.

    Targets are smoothed by one document of each kind, so that few documents, all on the right
    side, do not make all scores certain.
    """
    good = labels.sum()
    targets = np.where(labels == 1, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))

    def loss(log_temperature: float) -> float:
        scaled = odds / np.exp(log_temperature)
        return float((np.logaddexp(0, scaled) - targets * scaled).mean())

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        left, right = high - golden * (high - low), low + golden * (high - low)
        if loss(left) <= loss(right):
            high = right
        else:
            low = left
    return float(np.exp((low + high) / 2))


def fitted_network(
    features: np.ndarray, labels: np.ndarray, calibrates: np.ndarray, seed: int = 1
) -> Network:
    """Fitted by small batches to the rows that do not calibrate; the others set the temperature."""
    n_good = int(labels.sum())
    if not len(labels):
        return constant_network(0.5)
    learn = ~calibrates if len(np.unique(labels[~calibrates])) == 2 else np.ones(len(labels), bool)
    if n_good in (0, len(labels)):
        return constant_network((n_good + 1) / (len(labels) + 2))
    x, y = features[learn], labels[learn].astype(np.float64)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    values = [
        rng.normal(0, width**-0.5, (width, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(1),
    ]
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(x[rows] @ values[0] + values[1])
            error = 1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -60, 60))) - y[rows]
            error /= len(rows)
            back = error[:, None] * values[2] * (1 - hidden * hidden)
            slopes = [
                x[rows].T @ back + DECAY * values[0],
                back.sum(axis=0),
                hidden.T @ error + DECAY * values[2],
                error.sum(keepdims=True),
            ]
            step += 1
            for n, slope in enumerate(slopes):
                first[n] = 0.9 * first[n] + 0.1 * slope
                second[n] = 0.999 * second[n] + 0.001 * slope * slope
                size = np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8
                values[n] = values[n] - rate * first[n] / (1 - 0.9**step) / size
    network = Network(mean, spread, *values[:3], float(values[3][0]), 1.0)
    check = calibrates if calibrates.any() else learn
    return network._replace(
        temperature=temperature_of(network.odds(features[check]), labels[check])
    )


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _feature_rows(words):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))]
    )

    def run(batches):
        out, hashes = Out(schema), RowHashes()
        for doc_id, label, text in rows_of(batches):
            if out.add(doc_id, label, pooled(read_text(text, hashes), words.value)):
                yield out.batch()
        yield out.batch()

    return run


def _score_rows(words, network: Network):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        hashes = RowHashes()
        for batch in batches:
            features = [pooled(read_text(t, hashes), words.value) for _, t in rows_of([batch])]
            if features:
                scores = pa.array(network.scores(np.stack(features)))
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], schema=schema)

    return run


def learned(docs: DataFrame, labels: DataFrame, words, most: int = MOST_LABELLED) -> Network:
    """The network fitted to at most ``most`` labelled documents outside the held-out fold."""
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
        .where(F.col("label").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id")
        .agg((F.min("label") > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # At most ``most`` ids with a label each.
    rows = (
        docs.join(F.broadcast(sample), "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(_feature_rows(words), "doc_id long, label int, features array<double>")
        .withColumn("calibrates", fold(F.col("doc_id")) == CALIBRATION)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "features")
        .limit(most)
        .collect()
    )
    return fitted_network(
        np.array([r.features for r in rows]).reshape(len(rows), DIMENSIONS + N_SHARES),
        np.array([r.label for r in rows], np.int64),
        np.array([r.calibrates for r in rows], bool),
    )


def scores(
    docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = MOST_LABELLED
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text).

    ``labels`` are (doc_id, quality); ``predicted`` is 1 where the score is ``least`` or more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    context = docs.sparkSession.sparkContext
    # BUCKETS vectors, whatever the number of documents.
    words = context.broadcast(word_vectors(docs))
    network = learned(docs, labels, words, most)
    found = docs.mapInArrow(_score_rows(words, network), "doc_id long, score double")
    score = F.round("score", 9)
    return found.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(True)).alias("held_out"),
        score.alias("score"),
        (score >= least).cast("int").alias("predicted"),
    )
