"""Rows that operators must not stumble over, and plain versions of what they compute."""

from __future__ import annotations

import re
from collections import Counter

SCHEMA = (
    "doc_id long, text string, row string, spans string, n_words int, kept boolean, id int, "
    "text_key string, owner int, virtual_slot int, found int, matches string, held int"
)
LONG = " ".join(f"w{i * i * 31 % 99_991}" + "." * (i % 12 == 11) for i in range(30_000))
SENTENCE = "The old mill by the river still grinds corn for every farm of the wide green valley ."


def rows() -> list[tuple]:
    texts = [
        (1, SENTENCE),
        (2, SENTENCE),
        (2, SENTENCE),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (None, SENTENCE),
        (None, None),
        (6, LONG),
        (7, "a"),
        (8, "Ünïcødé 日本語 \U0001f600 ça va ."),
        (9, SENTENCE + " And more ."),
        (7, "another text for the same id"),
    ]
    return [(*t, "x", "y", 1, True, 2, "k", 3, 4, 5, "m", 6) for t in texts]


def frame(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def letter_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, width: int) -> set[tuple]:
    words = spaced_words(lower(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def groups(docs: list[tuple], width: int, percent: int) -> dict:
    """doc_id -> smallest id reachable by links."""
    sets = [(i, shingles(t, width)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def without_repeats(docs: list[tuple], width: int = 13) -> list[tuple]:
    """(doc_id, words, kept words) of every row."""
    last = 1 << 63
    first: dict[tuple, int] = {}
    for i, text in docs:
        words = spaced_words(text)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            first[window] = min(first.get(window, last), last if i is None else i)
    result = []
    for i, text in docs:
        words, gone = spaced_words(text), set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < (last if i is None else i):
                gone |= set(range(k, k + width))
        result.append((i, len(words), [w for k, w in enumerate(words) if k not in gone]))
    return result


def base_counts(text: str | None) -> tuple:
    words = spaced_words(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    lines = [x for x in (text or "").split("\n") if spaced_words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    repeats = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), symbols, repeats, len(covered)
