"""The quality classifier: word vectors against plain loops, held-out accuracy, awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelens.llm import quality_network as net
from tests.llm import awkward

FOLDER = "/root/testdata/sf0.1"


def plain_words(text):
    words = []
    for n, chunk in enumerate((text or "").encode().translate(net.LOWER).split()):
        for byte in chunk:
            kind = byte >= 128 or chr(byte).isalnum()
            if words and words[-1][0] == n and words[-1][1] == kind:
                words[-1][2].append(byte)
            else:
                words.append((n, kind, [byte]))
    return [bytes(w) for _, _, w in words]


def plain_sums(texts):
    index = net.index_vectors()
    sums = np.zeros((net.BUCKETS, net.DIMENSIONS + 1), np.int64)
    for text in texts:
        rows = [zlib.crc32(w) % net.BUCKETS for w in plain_words(text)]
        for i, row in enumerate(rows):
            sums[row, 0] += 1
            for j in range(max(0, i - net.NEAR), min(len(rows), i + net.NEAR + 1)):
                if i != j:
                    sums[row, 1:] += index[rows[j]]
    return sums


def context_sums(spark, texts, parts=3):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
    kinds = ", ".join(f"{n} long" for n in net._SUM_NAMES)
    sums = np.zeros((net.BUCKETS, net.DIMENSIONS + 1), np.int64)
    for row in docs.mapInArrow(net._context_rows, f"row int, {kinds}").collect():
        sums[row[0]] += np.array(row[1:])
    return sums


@pytest.mark.parametrize("at_once", [7, 100_000])
def test_context_sums_against_plain_loops(spark, monkeypatch, at_once):
    monkeypatch.setattr(net, "_WORDS_AT_ONCE", at_once)
    texts = ["A b, c -- d! é ü1", None, "", "  ", "x", "x x x x x x", "a|b a|b " * 20]
    texts += [t[1] for t in awkward.rows() if t[0] not in (6,)]
    wanted = plain_sums(texts)
    index = net.index_vectors()
    hashes, gap = net.RowHashes(), np.full(net.NEAR, net.BUCKETS, np.int32)
    sums = np.zeros((net.BUCKETS + 1, net.DIMENSIONS + 1), np.int64)
    for text in texts:
        rows = net.read_text(text, hashes).rows
        while len(rows) > at_once:
            net._add_contexts(rows[: at_once + net.NEAR], at_once, index, sums)
            rows = rows[at_once:]
        net._add_contexts(np.concatenate([rows, gap]), len(rows) + net.NEAR, index, sums)
    assert (sums[: net.BUCKETS] == wanted).all()
    assert (context_sums(spark, texts) == wanted).all()


def test_long_texts_are_read_whole(monkeypatch):
    whole = net.read_text(awkward.LONG, net.RowHashes())
    monkeypatch.setattr(net, "_PIECE", 50)
    pieces = net.read_text(awkward.LONG, net.RowHashes())
    assert whole.rows.tolist() == pieces.rows.tolist()
    assert whole[1:] == pieces[1:]
    assert len(whole.rows) == len(plain_words(awkward.LONG))


def labelled(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs, spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    found = net.scores(docs, labels)
    assert found.count() == docs.count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    loss = np.mean([-np.log(max(r.score if r.quality else 1 - r.score, 1e-9)) for r in rows])
    usual = max(np.mean([r.quality for r in rows]), 0.5)
    assert right > 0.97 > usual
    assert loss < 0.1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_labels_and_partitions_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn(
        "quality",
        F.when(net.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    one = {tuple(r) for r in net.scores(docs, labels).collect()}
    two = {tuple(r) for r in net.scores(docs.repartition(7), flipped).collect()}
    assert one == two
    assert len({r[2] for r in one}) > 50


def test_awkward_rows(spark):
    labels = [(1, 1, 0), (2, 0, 0), (2, 1, 1), (3, None, 0), (7, 0, 0), (9, 1, 1), (None, 0, 0), (77, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = net.scores(awkward.frame(spark), frame).collect()
    assert len(found) == len(awkward.rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {True}
    assert net.scores(awkward.frame(spark, []), frame).count() == 0
    none = net.scores(awkward.frame(spark), frame.where("quality = 5")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    bad = net.scores(awkward.frame(spark), frame.where("quality = 0")).collect()
    assert len({r.score for r in bad}) == 1
    assert bad[0].score < 0.5


def test_temperature():
    rng = np.random.default_rng(1)
    odds = rng.normal(0, 2, 20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-odds))).astype(int)
    assert net.temperature_of(odds, labels) == pytest.approx(1, abs=0.05)
    assert net.temperature_of(odds * 3, labels) == pytest.approx(3, abs=0.15)


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    rows = net.scores(docs, labels, most=200).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.85
