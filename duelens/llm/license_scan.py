"""License scans with a positional index of rare template words.

Templates are short license notices; some of their words are key phrases that must be there. The words of the key
phrases are counted over all documents, and each template is indexed under its rarest one (highest inverse document
frequency), with the place of that word in the template. In a file, each occurrence of an indexed word
gives, by its place less the posting's, a place where the template may start. There the key phrases
are verified word by word, and the share of all template words that stand in place is the score.

All of this is one expression over the words of a row: texts are not moved between tasks.

A null or empty text has no words, no labels and score 0. Equal rows are treated alike, whatever their ids. Words
equally rare are taken in template order. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_SCORE = 0.5


class Template(NamedTuple):
    label: str
    text: str
    #: Key phrases: all their words must stand in their places.
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory(self) -> list[int]:
        """Places of the words of the key phrases."""
        places = set()
        for phrase in self.keys:
            words = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(words)] == words)
            places |= set(range(at, at + len(words)))
        return sorted(places)


# The phrases and labels asked for, then the usual wording of notices.
TEMPLATES = [
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ("apache license", "version 2 0"),
    ),
    Template(
        "gpl-2.0",
        "this work is licensed under the gnu general public license version 2",
        ("gnu general public license version 2",),
    ),
    Template(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "mpl-2.0",
        "subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose",
        ("permission to use copy modify", "distribute this software"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software", "public domain"),
    ),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """In how many documents each word of a key phrase occurs; no larger than the templates."""
    known = sorted({t.words[i] for t in templates for i in t.mandatory})
    found = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, known)))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(known, 0) | {row[0]: row[1] for row in rows}


def _literal(templates: list[Template], frequency: dict[str, int]) -> tuple[Column, Column, Column]:
    """The indexed words, their postings, and the templates, as constants."""
    rarest = [min(t.mandatory, key=lambda i: (frequency[t.words[i]], i)) for t in templates]
    anchors = sorted({t.words[i] for t, i in zip(templates, rarest, strict=True)})
    postings = [
        F.array(
            *(
                F.struct(F.lit(n).alias("template"), F.lit(i).alias("at"))
                for n, (t, i) in enumerate(zip(templates, rarest, strict=True))
                if t.words[i] == word
            )
        )
        for word in anchors
    ]
    held = [
        F.struct(
            F.lit(t.label).alias("label"),
            F.lit(t.base).alias("base"),
            F.array(*map(F.lit, t.words)).alias("words"),
            F.array(*map(F.lit, t.mandatory)).alias("mandatory"),
        )
        for t in templates
    ]
    return F.array(*map(F.lit, anchors)), F.array(*postings), F.array(*held)


def _matches(words: Column, anchors: Column, postings: Column, templates: Column) -> Column:
    """Array of (template, start, score) of all places where a template is verified."""
    places = F.filter(
        F.transform(
            words, lambda w, i: F.struct(i.alias("i"), F.array_position(anchors, w).alias("word"))
        ),
        lambda place: place["word"] > 0,
    )
    starts = F.flatten(
        F.transform(
            places,
            lambda place: F.transform(
                F.get(postings, (place["word"] - 1).cast("int")),
                lambda p: F.struct(
                    p["template"].alias("template"), (place["i"] - p["at"]).alias("start")
                ),
            ),
        )
    )

    def in_place(start: Column, template: Column, i: Column) -> Column:
        same = F.get(words, start + i) == F.get(template["words"], i)
        return F.coalesce(same, F.lit(False))

    def verified(candidate: Column) -> Column:
        return _let(
            F.get(templates, candidate["template"]),
            lambda t: F.forall(t["mandatory"], lambda i: in_place(candidate["start"], t, i)),
        )

    def scored(candidate: Column) -> Column:
        def of(t: Column) -> Column:
            many = F.size(t["words"])
            found = F.size(
                F.filter(
                    F.sequence(F.lit(0), many - 1), lambda i: in_place(candidate["start"], t, i)
                )
            )
            return F.struct(
                t["label"].alias("label"),
                t["base"].alias("base"),
                candidate["start"].alias("start"),
                (found / many).alias("score"),
            )

        return _let(F.get(templates, candidate["template"]), of)

    good = F.filter(F.transform(F.filter(starts, verified), scored), lambda m: m["score"] >= LEAST_SCORE)
    nothing = F.expr("CAST(array() AS array<struct<label:string,base:boolean,start:int,score:double>>)")
    return F.when(F.arrays_overlap(words, anchors), good).otherwise(nothing)


def licenses(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Places and labels for each row of ``docs`` (doc_id, text).

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): the places where a
    base template starts, the labels of these and of all templates, the best share of words in place.
    """
    anchors, postings, held = _literal(templates, document_frequencies(docs, templates))
    found = docs.select(
        "doc_id",
        _let(
            words_of(F.col("text")),
            lambda words: F.struct(
                F.size(words).cast("long").alias("n_words"),
                _matches(words, anchors, postings, held).alias("matches"),
            ),
        ).alias("found"),
    ).select("doc_id", "found.n_words", "found.matches")

    def labels(matches: Column) -> Column:
        names = F.transform(matches, lambda m: m["label"])
        return F.array_join(F.sort_array(F.array_distinct(names)), ",")

    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    best = F.array_max(F.transform("matches", lambda m: m["score"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
