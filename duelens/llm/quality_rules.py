"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) or abstains (0) on a document. Documents with the same votes are one
pattern, at most three to the number of rules, whatever the data. Expectation maximisation over the counted
patterns of the documents that pass the fixed rules estimates, for either class, how often each rule gives each vote, and the share of good documents;
the posterior probability of being good then decides, instead of "all rules must pass". A good vote
never counts against a document and a bad one never for it, so without a bad vote it is kept.

Everything is computed in one row's expressions, written once, and one small aggregation; the driver sees
the counted patterns only.

A null or empty text has no words and fails. Ties of the posterior with the limit are kept. Rows are judged
each for itself, whatever their ids; other columns pass through, also if they bear a name used here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelens.operators.extract import computed_once
from duelens.operators.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
VOTES = (-1, 0, 1)
MOST_ROUNDS = 200

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_capitals", "n_ends", "n_distinct")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur at least twice.

    Windows are sorted by hash and place; equal neighbours are repeats. Their places, in order, each
    cover up to three words that the one before has not.
    """
    many = F.size(words)
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), many - 3),
            lambda i: F.struct(
                F.xxhash64(
                    F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
                ).alias("h"),
                i.alias("i"),
            ),
        )
    )

    def places(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda w, j: (w["h"] == F.get(ordered, j - 1)["h"])
            | (w["h"] == F.get(ordered, j + 1)["h"]),
        )
        return F.sort_array(F.transform(same, lambda w: w["i"]))

    covered = F.aggregate(
        _let(windows, places),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda seen, i: F.struct(
            (i + 3).alias("end"), (seen["n"] + F.least(F.lit(3), i + 3 - seen["end"])).alias("n")
        ),
        lambda seen: seen["n"],
    )
    return F.when(many < 3, 0).otherwise(covered)


def _without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def counts_of(text: Column) -> Column:
    """A struct of ``COUNTS``, all long."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.length(_without(text, SPACES))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).alias("n_words"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        )

    return F.struct(
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        bare.alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("n_capitals"),
        F.regexp_count(text, F.lit(r"[.!?:;]+(?=[\x20\x09-\x0D]|\z)")).alias("n_ends"),
    )


def _flat(held: str) -> list[Column]:
    inner = {"n_words": "w.", "n_repeat_words": "w.", "n_distinct": "w."}
    inner |= {"n_lines": "l.", "n_dup_lines": "l."}
    return [F.col(f"{held}.{inner.get(c, '')}{c}").cast("long").alias(c) for c in COUNTS]


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _low_share(part: str, whole: str, good: float, bad: float) -> Column:
    """Good where ``part`` is at most ``good`` percent of ``whole``, bad above ``bad`` percent."""
    least, most = F.col(whole) * good, F.col(whole) * bad
    return _vote(F.col(part) * 100 <= least, F.col(part) * 100 > most)


def rules() -> dict[str, Column]:
    """Name -> vote, over the columns of ``COUNTS``."""
    return {
        "long_enough": _vote(F.col("n_words") >= 100, F.col("n_words") < 50),
        "word_length": _vote(
            F.col("word_chars").between(F.col("n_words") * 3, F.col("n_words") * 12),
            (F.col("word_chars") < F.col("n_words") * 2)
            | (F.col("word_chars") > F.col("n_words") * 20),
        ),
        "symbols": _low_share("n_symbols", "n_words", 5, 20),
        "repeated_lines": _low_share("n_dup_lines", "n_lines", 10, 30),
        "repeated_words": _low_share("n_repeat_words", "n_words", 15, 40),
        "capitals": _low_share("n_capitals", "word_chars", 15, 40),
        "sentences": _vote(
            (F.col("n_ends") > 0) & (F.col("n_ends") * 3 <= F.col("n_words")),
            F.col("n_ends") * 100 > F.col("n_words") * 70,
        ),
        "variety": _vote(
            F.col("n_distinct") * 100 >= F.col("n_words") * 25,
            F.col("n_distinct") * 100 < F.col("n_words") * 5,
        ),
    }


def estimated(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """(log odds of a good document, for each rule the weight of each vote).

    ``patterns`` are (votes, documents). The start is "any bad vote is bad". As kinds of bad documents
    rarely share a defect, votes alone don't fix which classes are meant; so half of what each document
    adds to the counts stays with the start. Counts are smoothed by one document for each vote.
    """
    patterns = sorted(patterns)
    if not patterns:
        return 0.0, []
    width = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    start = [0.0 if -1 in votes else 1.0 for votes, _ in patterns]
    good = start
    prior, weights = 0.0, [dict.fromkeys(VOTES, 0.0) for _ in range(width)]
    for _ in range(MOST_ROUNDS):
        counted = [(a + g) / 2 for a, g in zip(start, good, strict=True)]
        weight = sum(n * g for (_, n), g in zip(patterns, counted, strict=True))
        share = min(max((weight + 1) / (total + 2), 0.5), 0.99)
        prior = math.log(share / (1 - share))
        for j in range(width):
            held = {v: [1.0, 1.0] for v in VOTES}
            for (votes, n), g in zip(patterns, counted, strict=True):
                held[votes[j]][1] += n * g
                held[votes[j]][0] += n * (1 - g)
            for v in VOTES:
                ratio = held[v][1] / (weight + 3) / (held[v][0] / (total - weight + 3))
                weights[j][v] = 0.0 if v == 0 else v * max(v * math.log(ratio), 0.0)
        new = [
            1 / (1 + math.exp(-max(prior + sum(map(dict.__getitem__, weights, v)), -700)))
            for v, _ in patterns
        ]
        moved = max(abs(a - b) for a, b in zip(good, new, strict=True))
        good = new
        if moved < 1e-9:
            break
    return prior, weights


def _votes() -> list[Column]:
    """The votes over the columns of ``COUNTS``, each named for its rule."""
    return [vote.cast("byte").alias(f"vote_{name}") for name, vote in rules().items()]


def _fitted(voted: DataFrame, votes: list[Column]) -> Column:
    """Posterior of being good over ``votes``, fitted to the rows of ``voted``, which has ``_votes``."""
    names = [f"vote_{name}" for name in rules()]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    prior, weights = estimated([(tuple(r[:-1]), r[-1]) for r in rows])
    odds = F.lit(prior)
    for vote, weight in zip(votes, weights, strict=False):
        odds = odds + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(0.0)
    return F.round(1 / (1 + F.exp(-odds)), 9)


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, posterior) of each row of ``docs`` (doc_id, text)."""
    held = docs.select("doc_id", counts_of(F.col("text")).alias("held"))
    counted = staged(held.select("doc_id", *_flat("held")))
    posterior = _fitted(counted.where(~_base_failed()).select(*_votes()), [*rules().values()])
    return counted.select(
        "doc_id",
        *BASE,
        _base_failed().alias("base_failed"),
        (~_base_failed() & (posterior >= least)).alias("kept"),
        posterior.alias("posterior"),
    )


def good_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; texts are not moved between tasks.

    Words are counted once: rows that pass the fixed rules are written with their votes, which are then fitted and judged.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    held = computed_once(whole, {"held": counts_of(F.col("row.text"))})
    counted = held.select("row", *_flat("held")).where(~_base_failed())
    voted = staged(counted.select("row", *_votes()))
    posterior = _fitted(voted, [F.col(f"vote_{name}") for name in rules()])
    return voted.where(posterior >= least).select("row.*")
