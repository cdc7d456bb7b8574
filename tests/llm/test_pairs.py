"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from duelens.llm import ngram_join, substring_dedup
from duelens.llm.words import WordHashes, components
from tests.llm import awkward

FOLDER = "/root/testdata/sf0.001"


def edited(words: list[str], rng: random.Random, share: float) -> list[str]:
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


def families(seed: int) -> list[tuple]:
    """Families of copies with growing numbers of edits, short texts, and a common passage."""
    rng, docs = random.Random(seed), []
    common = [f"c{i}" for i in range(60)]
    for _ in range(12):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 20, 60, 300]))]
        for _ in range(8):
            docs.append(edited(words, rng, rng.choice([0, 0.005, 0.01, 0.02, 0.05])))
        docs.append(words[: len(words) // 2] + common)
    rng.shuffle(docs)
    return [(i + 1, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_groups_of_families(spark, width, percent):
    docs = families(width)
    found = ngram_join.shingle_groups(
        spark.createDataFrame(docs, "doc_id long, text string"), width, percent
    ).collect()
    wanted = awkward.groups(docs, width, percent)
    assert {r.doc_id: r.component_id for r in found} == wanted
    sizes = {i: len(awkward.shingles(t, width)) for i, t in docs}
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    assert len(set(wanted.values())) < len(wanted)


def test_groups_of_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    found = ngram_join.shingle_groups(docs, 3, 90).collect()
    assert {r.doc_id: r.component_id for r in found} == awkward.groups(plain, 3, 90)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(awkward.groups(plain, 5, 80).values())


def test_groups_of_awkward_rows(spark):
    found = ngram_join.shingle_groups(awkward.frame(spark), 3, 90).collect()
    assert len(found) == len(awkward.rows())
    assert {(r.doc_id, r.component_id) for r in found} == {
        (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (None, 1), (None, None), (6, 6), (7, 7), (8, 8), (9, 9)
    }
    kept = ngram_join.one_of_each_group(awkward.frame(spark), 3, 90)
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 3, 4, 5, 6, 7, 7, 8, 9, None]
    assert ngram_join.shingle_groups(awkward.frame(spark, [])).count() == 0


def test_texts_of_one_id_are_judged_each_for_itself(spark):
    a, b = awkward.LONG[:400], "B " + " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, 1), (5, b, 2), (5, a, 3), (5, b + " end", 4), (None, b, 5), (None, "c d", 6), (None, "c d", 6)]
    rows += [(8, "", 7), (8, "", 8), (None, "", 9), (None, None, 9), (9, "e f", 10), (9, "g h", 11), (9, "e f", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    for parts in (1, 3):
        kept = sorted(map(tuple, ngram_join.one_of_each_group(docs.repartition(parts)).collect()), key=repr)
        texts = [(i, t) for i, t, _ in kept]
        assert sorted(texts, key=repr) == sorted(
            [(1, a), (5, b if (5, b) in texts else b + " end"), (None, "c d"), (8, ""), (9, "e f")]
            + [(9, "g h"), (None, ""), (None, None)],
            key=repr,
        )


@pytest.mark.parametrize("block", [3, 1000])
def test_crowded_tiles_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    docs = [(i, " ".join(edited(base, rng, rng.choice([0, 0.01, 0.02, 0.04])))) for i in range(150)]
    found = ngram_join.shingle_groups(
        spark.createDataFrame(docs, "doc_id long, text string"), 3, 90
    ).collect()
    assert {r.doc_id: r.component_id for r in found} == awkward.groups(docs, 3, 90)


def test_neighbours_are_compared_where_they_lie(spark, monkeypatch):
    rng = random.Random(3)
    text = [f"w{i}" for i in range(400)]
    copies = []
    for n in range(400):
        words = list(text)
        for place in rng.sample(range(400), 6):
            words[place] = f"x{n}-{place}"
        copies.append((n, " ".join(words)))
    found, plain = [], ngram_join._neighbours

    def seen(*given):
        rows = plain(*given)
        found.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows

    monkeypatch.setattr(ngram_join, "_neighbours", seen)
    groups = ngram_join.shingle_groups(spark.createDataFrame(copies, "doc_id long, text string"), 3, 80)
    assert {row.component_id for row in groups.collect()} == {0}
    # One round joins the group, the next one sees that; no pair is listed to be compared by a join.
    assert 1 <= len(found) <= 2 and not any("Join" in plan for plan in found)


@pytest.mark.parametrize("percent", [80, 90])
def test_a_common_segment_is_certain(percent):
    """Sets at the threshold always share a tile."""
    rng = np.random.default_rng(percent)
    for size in (10, 11, 19, 20, 57, 300, 1001):
        for _ in range(20):
            union = np.unique(rng.integers(0, 1 << 63, size * 2, dtype=np.uint64))
            most = size * (100 - percent) // percent
            extra = int(rng.integers(0, most + 1))
            left, right = union[: size - extra // 2], union[extra // 2 : size + extra]
            left, right = np.sort(left), np.sort(right)
            shared = len(np.intersect1d(left, right))
            if 100 * shared < percent * (len(left) + len(right) - shared):
                continue
            if len(left) == len(right) == shared:
                continue
            found = [ngram_join.tiles_of(s, percent) for s in (left, right)]
            tiles = [set(keys.tolist()) for keys, _, _ in found]
            assert tiles[0] & tiles[1]
            # In some band both share as many tiles as either needs.
            assert any(
                len({k for k, h in zip(*found[0][:2], strict=True) if h == x} & tiles[1])
                >= max([n for _, h, n in zip(*found[0], strict=True) if h == x], default=1)
                and len({k for k, h in zip(*found[1][:2], strict=True) if h == y} & tiles[0])
                >= max([n for _, h, n in zip(*found[1], strict=True) if h == y], default=1)
                for x in (True, False)
                for y in (True, False)
                if x or y
            )
            assert any(ngram_join.tiles_of(s, percent)[1].any() for s in (left, right))
            apart = ngram_join.parity_bitmap(left) ^ ngram_join.parity_bitmap(right)
            bits = int(np.bitwise_count(apart.view(np.uint64)).sum())
            assert bits <= len(left) + len(right) - 2 * shared


def test_word_hashes_stay_bounded():
    hashes = WordHashes(most=10)
    first = hashes.of([b"%d" % i for i in range(50)])
    assert hashes.of([b"7"])[0] == first[7]
    assert len(hashes) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).selectExpr("id AS a", "id + 1 AS b")
    more = spark.createDataFrame([(500, 400), (400, 500), (300, 300)], "a long, b long")
    found = {r.id: r.component for r in components(edges.union(more)).collect()}
    assert found == {i: 1 for i in range(1, 201)} | {400: 400, 500: 400}


def _plain_repeats(docs, width=13):
    return sorted(
        (str(i), n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        for i, n, kept in awkward.without_repeats(docs, width)
    )


def _found_repeats(docs, width=13):
    rows = substring_dedup.without_repeats(docs, width).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows)


def test_repeats_of_families(spark):
    docs = families(7)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert _found_repeats(frame) == _plain_repeats(docs)
    assert _found_repeats(frame, 4) == _plain_repeats(docs, 4)


def test_repeats_of_awkward_rows(spark):
    docs = [r[:2] for r in awkward.rows()]
    assert _found_repeats(awkward.frame(spark)) == _plain_repeats(docs)
    assert _found_repeats(awkward.frame(spark, [])) == []


def test_repeats_of_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert _found_repeats(docs) == _plain_repeats(plain)


def test_paths_are_compacted(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(words)), (2, " ".join(["a", *words[20:60], "b", *words[10:30]]))]
    _, paths = substring_dedup.repeated_paths(
        spark.createDataFrame(docs, "doc_id long, text string")
    )
    found = {(r.owner, r.start, r.edges, r.source) for r in paths.collect()}
    assert found == {(2, 1, 28, 1), (2, 42, 8, 1)}


@pytest.mark.parametrize("rows", [1, 200])
def test_repeats_in_small_parts(spark, monkeypatch, rows):
    """The same when tasks send their rows on after a few texts."""
    monkeypatch.setattr(substring_dedup, "_HELD_ROWS", rows)
    docs = families(8)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert _found_repeats(frame) == _plain_repeats(docs)


def test_long_join_conditions_are_compiled_by_operator(spark, monkeypatch):
    """One method with the whole comparison of two bitmaps was too large to be compiled."""
    compiled, plain = [], ngram_join.staged

    def noted(rows, **how):
        if "Join" in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and "bit_count" in plan:
            compiled.append(how.get("wide", False))
        return plain(rows, **how)

    monkeypatch.setattr(ngram_join, "staged", noted)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} x{i}") for i in range(12)], "doc_id long, text string")
    assert ngram_join.one_of_each_group(docs, 5, 80).count() == 1
    assert compiled and all(compiled)
