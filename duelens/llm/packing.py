"""Best-two-fit packing of tokenized documents into sequences of equal length.

Documents are tokenized once and cut only where they are longer than a sequence. Pieces of equal length
are alike for packing, so the plan is made from the number of pieces of each length (as many
numbers as a sequence has places, whatever the data): a bin is filled greedily with the longest
pieces that fit; then its smallest piece gives way to two others that fill the widened gap more
tightly, as long as there are such; and the finished bin is repeated as often as the pieces last.
Each piece finds its place by its rank among the pieces of its length. Ranks are formed in small
buckets, so that a length that a third of all pieces share is spread over many tasks.

The added tokens of the tokenizer file are found in a text first and have their own ids, as the
tokenizer does it; only the parts between them are split into words and encoded.

A null text is an empty text: one piece of the end id alone. Repeated rows are packed as often as
they occur; rows with equal ids and texts may swap places. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.llm.words import Out, rows_of
from duelens.operators.staging import staged

LENGTH = 2048
END_ID = 0
BUCKETS = 1024
_KNOWN_WORDS = 300_000


def added_tokens(tokenizer: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file with their ids."""
    with open(tokenizer, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"not a plain added token: {token}")
    return {token["content"]: token["id"] for token in tokens}


class Encoder:
    """Byte-level BPE whose ids come from a file of ranks, and ``added`` tokens with ids of their own.

    Where single spaces and line feeds are all the white space of a text, the tokenizer's split falls
    before each of them, so words are encoded once and their ids remembered, up to a bound.
    ``Encoder.encode`` gives little-endian unsigned 32-bit ids.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines]
        self._bpe = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
            special_tokens={},
        )
        self._added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        self._line_feed = self._ids("\n")
        self._known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words, encoded in one go; those after a line feed begin with it, others follow a space."""
        new = {}
        mark = int.from_bytes(self._line_feed, "little")
        for lead, chosen in (
            (" ", [w for w in words if not w.startswith("\n")]),
            ("", [w[1:] for w in words if w.startswith("\n")]),
        ):
            if not chosen:
                continue
            ids = np.array(
                self._bpe.encode_ordinary("\n".join(lead + w for w in chosen)), "<u4"
            )
            cuts = np.flatnonzero(ids == mark)
            starts = [0, *(cuts + 1).tolist()]
            ends = [*cuts.tolist(), len(ids)]
            data = ids.tobytes()
            for word, start, end in zip(chosen, starts, ends, strict=True):
                held = data[4 * start : 4 * end]
                if lead:
                    new[word] = held
                else:
                    new["\n" + word] = self._line_feed + held
        return new

    def encode(self, text: str) -> bytes:
        if self._cut is None or not self._cut.search(text):
            return self._between(text)
        parts = self._cut.split(text)
        return b"".join(self._added[p] if i % 2 else self._between(p) for i, p in enumerate(parts))

    def _between(self, text: str) -> bytes:
        if " ".join(text.split()) != text.replace("\n", " ") or not text:
            return self._ids(text)
        words = ("\n" + text.replace("\n", " \n")).split(" ")
        found = list(map(self._known.get, words))
        if None in found:
            places = [i for i, ids in enumerate(found) if ids is None]
            new = self._learned({words[i] for i in places})
            for i in places:
                found[i] = new[words[i]]
            if len(self._known) < _KNOWN_WORDS:
                self._known |= new
        return b"".join(found)[4:]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, added: dict[str, int]) -> Encoder:
    """The encoder of a file and added tokens; a Python worker builds it once."""
    key = (path, *added.items())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, added)
    return _ENCODERS[key]


def piece_bounds(many: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``many`` ids: only the first may be shorter."""
    first = many % length or length
    yield 0, min(first, many)
    for start in range(first, many, length):
        yield start, length


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def _piece_rows(path: str, added: dict[str, int], length: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bpe = Out(_PIECES), encoder(path, added)
        end = np.array([END_ID], "<u4").tobytes()
        for doc_id, text in rows_of(batches):
            ids = bpe.encode(text or "") + end
            for number, (start, many) in enumerate(piece_bounds(len(ids) // 4, length)):
                mark = zlib.crc32(ids[4 * start : 4 * (start + many)])
                if out.add(doc_id, number, start, many, mark):
                    yield out.batch()
        yield out.batch()

    return run


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs`` (doc_id, text).

    The tokenizer's JSON file has the name of ``vocabulary`` with the ending ``.json``.
    """
    added = added_tokens(vocabulary.removesuffix(".tiktoken") + ".json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _piece_rows(vocabulary, added, length),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def _best_pair(counts: np.ndarray, gap: int, above: int) -> tuple[int, int] | None:
    """Two free lengths that together fill most of ``gap``, if that is more than ``above``."""
    lengths = np.arange(gap + 1)
    free = counts[: gap + 1] > 0
    below = np.maximum.accumulate(np.where(free, lengths, 0))
    lower = np.concatenate([[0], below[:-1]])
    other = below[gap - lengths]
    alone = np.where(counts[: gap + 1] > 1, lengths, lower)
    other = np.where(other == lengths, alone, other)
    total = np.where(free & (other > 0), lengths + other, 0)
    at = int(total.argmax())
    return (at, int(other[at])) if total[at] > above else None


def packing_plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) until all pieces are used.

    ``counts[n]`` is the number of pieces of ``n`` ids, 0 <= n <= ``length``.
    """
    counts = counts.copy()
    plan = []
    while counts.any():
        bin_, gap = [], length
        while gap:
            fits = np.flatnonzero(counts[: gap + 1])
            if not len(fits):
                break
            taken = int(fits[-1])
            many = min(gap // taken, int(counts[taken]))
            bin_ += [taken] * many
            counts[taken] -= many
            gap -= taken * many
        while gap and (pair := _best_pair(counts, gap + bin_[-1], bin_[-1])):
            counts[bin_[-1]] += 1
            gap += bin_.pop() - sum(pair)
            for taken in pair:
                counts[taken] -= 1
            bin_ = sorted([*bin_, *pair], reverse=True)
        used = Counter(bin_)
        more = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= more * k
        plan.append((bin_, more + 1))
    return plan


def _segments(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, offset), by length and first rank."""
    rows, ranks, sequence = [], Counter(), 0
    for bin_, many in plan:
        offset = 0
        for n, k in Counter(bin_).items():
            rows.append((n, ranks[n], k, sequence, offset))
            ranks[n] += k * many
            offset += n * k
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place_rows(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = np.int64(48)
        keys = (table[:, 0] << bits) + table[:, 1]
        for batch in batches:
            *columns, rank = batch.columns
            length, rank = columns[3].to_numpy(), rank.to_numpy()
            at = np.searchsorted(keys, (length << bits) + rank, side="right") - 1
            _, first, k, sequence, offset = table[at].T
            copy, within = np.divmod(rank - first, k)
            columns += [pa.array(sequence + copy), pa.array(offset + within * length)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PLACED)

    return run


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Every piece with its sequence and its offset there.

    The driver sees only how many pieces there are of each length.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).alias("bucket")
    rows = staged(pieces(docs, vocabulary, length).select("*", bucket))
    held = rows.groupBy("length", "bucket").agg(F.count("*").alias("held"))
    counts = np.zeros(length + 1, np.int64)
    for n, many in held.groupBy("length").agg(F.sum("held")).collect():
        counts[n] = many
    segments = _segments(packing_plan(counts, length))
    before = held.selectExpr(
        "length",
        "bucket",
        "sum(held) OVER (PARTITION BY length ORDER BY bucket) - held AS before",
    )
    ranked = rows.selectExpr(
        "*",
        "row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, ids_crc32) - 1"
        " AS place",
    )
    shared = docs.sparkSession.sparkContext.broadcast(segments)
    return (
        ranked.join(before, ["length", "bucket"])
        .select(
            *(F.col(f.name) for f in _PIECES),
            (F.col("before") + F.col("place")).cast("long").alias("rank"),
        )
        .mapInArrow(
            _place_rows(shared),
            "doc_id long, piece int, start long, length long, ids_crc32 long, "
            "sequence_id long, offset long",
        )
    )
