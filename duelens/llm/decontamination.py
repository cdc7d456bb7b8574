"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (lower case, punctuation dropped) make an automaton of at most two states a word.
Every document's words are streamed through it; at each word it gives the longest run that ends there
and occurs in some item. Where that run has at least ``window`` words, the last ``window`` of them
are a window of an item; items with fewer words count as one window of their own length.

The items are the stated query set: they are read in blocks of at most ``BLOCK_WORDS`` words, one
automaton each, which bounds what is broadcast; every document passes all blocks.

A null or empty text has no words and no hits, and so has an item without words. An item without
an id hits words but is not listed; rows that repeat an item's id are one item. Repeated documents are
treated alike, each for itself. Other columns, of whatever name, are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelens.llm.words import letter_words

BLOCK_WORDS = 100_000
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


class SuffixAutomaton:
    """All runs of words of several items.

    ``step[s]`` are the moves of state ``s``, ``length[s]`` its longest run, ``link[s]`` the state
    of its longest suffix that occurs in more places. ``window_state[s]`` is the state of the last
    ``window`` words of a run in ``s``, and ``owners`` names the items of such a state. ``short[s]``
    are (number of words, item) of the items below ``window`` words that end in a run of ``s``.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.length, self.link, self.window = [0], [-1], window
        for _, words in items:
            last = 0
            for word in words:
                last = self._extended(last, word)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.window_state = [0] * len(self.length)
        for s in by_length:
            if self.length[s] >= window:
                up = self.link[s]
                self.window_state[s] = s if self.length[up] < window else self.window_state[up]
        self.owners: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str | None]]] = {}
        for item, words in items:
            state = 0
            for i, word in enumerate(words):
                state = self.step[state][word]
                if i + 1 >= window:
                    held = self.owners.setdefault(self.window_state[state], set())
                    if item is not None:
                        held.add(item)
            if 0 < len(words) < window:
                own.setdefault(state, []).append((len(words), item))
        self.short: list[tuple] = [()] * len(self.length)
        for s in by_length if own else ():
            self.short[s] = (*own.get(s, ()), *self.short[self.link[s]])

    def _new(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.step.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The state of the runs into ``target`` that are no longer than those through ``state``."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: bytes) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.step[last][word])
        return new

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [start, end) runs of hit words, and the items whose windows occur."""
        step, link, length, window = self.step, self.link, self.length, self.window
        spans: list[list[int]] = []
        states, items = set(), set()
        state = run = 0
        for i, word in enumerate(words):
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = step[state].get(word)
            if to is None:
                run = 0
                continue
            state, run = to, run + 1
            if run >= window:
                states.add(self.window_state[state])
                _joined(spans, i + 1 - window, i + 1)
            for many, item in self.short[state]:
                if many <= run:
                    items.add(item)
                    _joined(spans, i + 1 - many, i + 1)
        for s in states:
            items |= self.owners[s]
        return spans, items - {None}


def _joined(spans: list[list[int]], start: int, end: int) -> None:
    """Add a run that ends at or after all others."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def _union(left: list, right: list) -> list[list[int]]:
    spans: list[list[int]] = []
    for start, end in sorted([*left, *right]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return spans


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, in blocks of at most ``BLOCK_WORDS`` words (or one longer item)."""
    block, held = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = letter_words(text)
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    yield block


#: The automaton of the last block that this Python process has read; its tasks share it.
_BUILT: dict[tuple[str, int], SuffixAutomaton] = {}


def automaton_of(name: str, block, window: int) -> SuffixAutomaton:
    """The automaton of a block with a name of its own, built once in a process."""
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = SuffixAutomaton(block.value, window)
    return _BUILT[name, window]


def _scan(name: str, block, window: int, first: bool):
    """Add a block's hits to batches of (row, found so far)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(name, block, window)
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field(rows.type.get_field_index("text"))
            counts, spans, items = [], [], []
            for i in range(batch.num_rows):
                words = letter_words(texts[i].as_py())
                hit, names = automaton.matches(words)
                if not first:
                    before = [[s["start"], s["end"]] for s in batch.column(2)[i].as_py()]
                    hit, names = _union(before, hit), names | set(batch.column(3)[i].as_py())
                counts.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in hit])
                items.append(sorted(names))
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            found = [
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(span)),
                pa.array(items, pa.list_(pa.string())),
            ]
            names = ["row", "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays([rows, *found], names=names)

    return run


def found_items(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(row, n_words, spans, items): each document as a struct, its hit runs of words, the items."""
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = (
        T.StructType()
        .add("row", docs.schema)
        .add("n_words", T.LongType())
        .add("spans", T.ArrayType(span))
        .add("items", T.ArrayType(T.StringType()))
    )
    for number, block in enumerate(item_blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = found.mapInArrow(_scan(uuid4().hex, shared, window, number == 0), schema)
    return found


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each run of words."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*kept, text[at:]])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, spans = batch.column(0), batch.column(1)
        at = rows.type.get_field_index("text")
        columns = rows.flatten()
        texts = columns[at]
        columns[at] = pa.array(
            [
                without_spans(texts[i].as_py(), [(s["start"], s["end"]) for s in hit])
                if (hit := spans[i].as_py())
                else texts[i].as_py()
                for i in range(batch.num_rows)
            ],
            texts.type,
        )
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in rows.type])


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, most_percent: int = 50
) -> DataFrame:
    """``docs`` without the words that occur in the items.

    A document with more than ``most_percent`` of its words hit is left out; of the others, runs of
    ``window`` words or more (and whole shorter items) are cut from the text.
    """
    found = found_items(docs, benchmark, window)
    hit = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long")
    )
    kept = found.where(hit * 100 <= F.col("n_words") * most_percent)
    return kept.select("row", "spans").mapInArrow(_cut, docs.schema)
