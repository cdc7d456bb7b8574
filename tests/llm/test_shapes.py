"""Sharding, packing, pages, quotes and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from duelens.llm import decontamination, html_extract, packing, quality_rules, queries, quote_links, secret_scan, sharding
from tests.llm import awkward

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def shards_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    return by


def test_shards_hold_equal_bytes(spark):
    rows = queries.QUERIES["op1_virtual_slots"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(data) + 1, zlib.crc32(data), None)
    by = shards_of(rows)
    assert sorted(by) == list(range(16))
    assert all(sorted(r.slot for r in held) == list(range(len(held))) for held in by.values())
    loads = [sum(r.size for r in held) for held in by.values()]
    assert max(loads) - min(loads) <= max(r.size for r in rows) / 4


def test_map_is_edited_in_versions(spark, tmp_path):
    rows = sharding.records(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    sizes, path = sharding.slot_sizes(rows), str(tmp_path / "map")
    sharding.store_map(sharding.first_map(spark, sizes, 4), path)
    sharding.store_map(sharding.next_map(sharding.load_map(spark, path), sizes, 5), path)
    sharding.store_map(sharding.next_map(sharding.load_map(spark, path), sizes, 3), path)
    old, new, less = (
        {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2, 3)
    )
    assert len(old) == len(new) == len(less) == sharding.SLOTS
    held = {r.virtual_slot: r.bytes for r in sizes.collect()}
    moved = [s for s in old if old[s] != new[s]]
    assert sum(held.get(s, 0) for s in moved) < 0.35 * sum(held.values())
    assert set(less.values()) == {0, 1, 2}
    loads = Counter()
    for slot, shard in new.items():
        loads[shard] += held.get(slot, 0)
    assert max(loads.values()) < 1.3 * min(loads.values())


def test_shards_of_awkward_rows(spark):
    frame = sharding.records(awkward.frame(spark))
    sizes = sharding.slot_sizes(frame)
    placed = sharding.placed(frame, sizes, sharding.first_map(spark, sizes, 3)).collect()
    assert len(placed) == len(awkward.rows())
    assert all(sorted(r.slot for r in held) == list(range(len(held))) for held in shards_of(placed).values())
    assert {r.size for r in placed if r.doc_id in (3, 4)} == {1}
    none = sharding.records(awkward.frame(spark, []))
    sizes = sharding.slot_sizes(none)
    assert sharding.placed(none, sizes, sharding.first_map(spark, sizes, 3)).count() == 0


ODD_TEXTS = [
    "", "a", "\n", "\na", "a\n", " a", "a  b", "a\n\nb", "x y\nz", "<|endoftext|> hi", "don't 'll we're",
    "a b c", "tab\there ok", "a\x1cb c", "日本 語\n", "é è", "a\n b", "  lead", "12 3,4 5", "\r\n x\r\n",
]


def test_ids_are_those_of_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + ODD_TEXTS
    own = packing.Encoder(VOCABULARY, packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    for _ in range(2):
        for text, coded in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == coded.ids


MARK = "<|endoftext|>"
MARKED = [
    "x" + MARK, MARK, MARK * 2, f"a b {MARK} c\nd", f"{MARK}\n\nx  y", f"one {MARK}two\n{MARK} three",
    "<|endoftext|", "<|<|endoftext|>|>", "plain words",
]


def test_added_tokens_have_their_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    found = {r.doc_id: (r.length, r.ids_crc32) for r in packing.packed(docs, VOCABULARY).collect()}
    for i, text in enumerate(MARKED):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert found[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_bounded_words(monkeypatch):
    whole = packing.Encoder(VOCABULARY)
    monkeypatch.setattr(packing, "_KNOWN_WORDS", 3)
    few = packing.Encoder(VOCABULARY)
    for text in ["one two three four five", "one six\nseven", "two two eight"]:
        assert few.encode(text) == whole.encode(text)
    assert len(few._known) <= 8


def check_packing(rows, length):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, many in sorted(places):
            assert offset == end
            end += many
        assert end <= length
    return len(held)


def test_whole_table_is_packed(spark):
    rows = queries.QUERIES["op7_best_two_fit_packing"](spark, FOLDER).collect()
    bins = check_packing(rows, 2048)
    assert bins <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = [*tokenizer.encode(d.text, add_special_tokens=False).ids, 0]
        own = sorted(pieces.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert not pieces


def test_plans_use_every_piece():
    rng = np.random.default_rng(5)
    for _ in range(30):
        length = int(rng.integers(4, 60))
        counts = np.zeros(length + 1, np.int64)
        for n in rng.integers(1, length + 1, int(rng.integers(0, 200))):
            counts[n] += 1
        plan = packing.packing_plan(counts, length)
        used = Counter()
        for bin_, many in plan:
            assert sum(bin_) <= length and bin_
            for n in bin_:
                used[n] += many
        assert used == {n: c for n, c in enumerate(counts.tolist()) if c}


def test_two_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.packing_plan(counts, 10)[0] == ([6, 2, 2], 1)


def test_packing_of_awkward_rows(spark):
    rows = packing.packed(awkward.frame(spark), VOCABULARY, 64).collect()
    check_packing(rows, 64)
    assert {r.length for r in rows if r.doc_id in (3, 4)} == {1}
    assert sum(r.piece == 0 for r in rows) == len(awkward.rows())
    assert packing.packed(awkward.frame(spark, []), VOCABULARY).count() == 0


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy, buy, buy</div>"
     "<article><h1>Title</h1><p>One &amp; <b>two</b>,<br>three<p>four  \n five</article>"
     "<footer>&copy; me</footer></body></html>", "Title One & two, three four five"),
    ("<div id=header><a href=/>Home</a></div><div id=content><p>Some text, with commas, here.</p><p>More text.</p>"
     "<div class=comments><p>I say, so, there, a lot, of, commas</p></div></div><div class='site-footer'>f</div>",
     "Some text, with commas, here. More text."),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>text<script>var x = '<p>no</p>';</script> goes on<!-- <p>no --></p><form><p>no</form></article>",
     "text goes on"),
    ("<p>ab<b>c</b>d</p><ul><li>x<li>y</ul>", "abcd x y"),
    ("plain", "plain"),
    ("", ""),
    (None, ""),
    ("<<p>>", "< >"),
    ("<body><nav><ul><li>a</nav><div><p>kept, it is</p></div>", "kept, it is"),
    ("<article><header><h1>H</h1></header><p>x</p><aside>no</aside></article><section id='comments'><p>a, b, c, d, e</p></section>",
     "H x"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


LONG_TEXT = "A long text, with commas, of many words, that goes on and on. " * 6
WHOLE_PAGES = [
    (f"<article><p>{LONG_TEXT}</p><figure><table><tr><td>cell</table><figcaption>Caption.</figcaption></figure>"
     "<p><label>Note:</label> see <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>"
     "<object data=a><param name=b><p>Instead.</p></object></article>",
     f"{LONG_TEXT}cell Caption. Note: see x=1 Instead."),
    (f"<div class='content no-sidebar'><p>{LONG_TEXT}</p></div>", LONG_TEXT.strip()),
    (f"<div class='has-cookie-notice'><article><p>{LONG_TEXT}</article></div>", LONG_TEXT.strip()),
    (f"<div class='page menu'><main><p>{LONG_TEXT}</main></div><div id=nav-menu>Go</div>", LONG_TEXT.strip()),
    (f"<div class=widget><div><p>{LONG_TEXT}</p></div></div><div class='ad-slot top'>Buy</div>", LONG_TEXT.strip()),
    (f"<article><p>{LONG_TEXT}</article><div id=comments><article class=comment><p>{LONG_TEXT * 3}</article></div>",
     LONG_TEXT.strip()),
    (f"<div>Loose <b>text</b> first.<section><p>{LONG_TEXT}</p></section><section><p>Short one.</p></section>"
     "<div><a href=x>Much</a> of <a href=y>linked text here</a></div>Last words here.<a href=z>More</a></div>",
     f"Loose text first. {LONG_TEXT}Short one. Last words here.More"),
    (f"<div data-hidden=1 data-id=sidebar title='x hidden y'><p>{LONG_TEXT}</p></div><div hidden>no</div>", LONG_TEXT.strip()),
]


@pytest.mark.parametrize(("page", "text"), WHOLE_PAGES)
def test_nothing_else_is_left_out(page, text):
    assert html_extract.main_text(page) == text


def test_pages_of_any_depth():
    assert html_extract.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html_extract.main_text("<b>" * 20_000 + "<p>x") == "x"
    assert html_extract.main_text("</div>" * 50_000 + "<p>y</p>") == "y"


def test_page_rows(spark):
    rows = [(i, None if i else "u", p, "t") for i, (p, _) in enumerate(PAGES)] + [(None, "v", "<p>z", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_extract.main_texts(frame).collect()
    assert {(r.page_id, r.text, r.n_chars) for r in found} == {
        (i, t, len(t)) for i, (_, t) in enumerate(PAGES)
    } | {(None, "z", 1)}
    assert html_extract.main_texts(frame.where("false")).count() == 0


MESSAGES = [
    (1, 0, "user", "First point.\n\nSecond  point here."),
    (1, 1, "user", "An aside."),
    (1, 2, "assistant", "> first POINT.\nI agree."),
    (1, 3, "user", ">> First point.\n> I agree.\nBut why?"),
    (1, 4, "user", "> nobody said this\nWell."),
    (1, 4, "user", "again the same turn"),
    (1, 6, "user", "> > > >\n"),
    (1, 9, "user", "> An aside.\n>\n> unknown words\n\nyes"),
    (2, 0, "user", "> First point.\nother place"),
    (None, 0, "user", "> An aside.\nnobody"),
    (3, None, None, None),
]


def test_quotes_lead_to_first_messages(spark):
    frame = spark.createDataFrame(
        [(*m, "x", 1) for m in MESSAGES], "conv_id long, turn long, role string, text string, runs string, key int"
    )
    found = {(r.conv_id, r.turn, r.text): tuple(r)[4:] for r in quote_links.conversations(frame).collect()}
    assert found == {
        (1, 0, "First point.\n\nSecond  point here."): (None, 0, 0, 0, 0),
        (1, 1, "An aside."): (0, 0, 1, 0, 0),
        (1, 2, "I agree."): (0, 0, 1, 1, 1),
        (1, 3, "But why?"): (2, 0, 2, 2, 2),
        (1, 4, "Well."): (3, 0, 3, 1, 0),
        (1, 4, "again the same turn"): (3, 0, 3, 0, 0),
        (1, 6, ""): (None, 6, 0, 1, 0),
        (1, 9, "yes"): (1, 0, 2, 1, 1),
        (2, 0, "other place"): (None, 0, 0, 1, 0),
        (None, 0, "nobody"): (None, 0, 0, 1, 0),
        (3, None, ""): (None, None, 0, 0, 0),
    }
    assert quote_links.conversations(frame.where("false")).count() == 0


def test_threads_of_a_long_conversation(spark):
    parents = spark.range(100).selectExpr("7L AS conv_id", "id AS turn", "if(id = 0, NULL, id - 1) AS parent_turn")
    assert {(r.turn, r.depth) for r in quote_links.threads(parents).collect()} == {(i, i) for i in range(100)}


def test_pipeline_against_plain_steps(spark):
    """Each stage on what the one before has kept, by the plainest means."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    stay = set(awkward.groups(list(texts.items()), 5, 80).values())
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    windows = set()
    for item in items:
        words = awkward.letter_words(item.text)
        windows |= {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
    left = {}
    for i in stay:
        words, hit = awkward.letter_words(texts[i]), set()
        for k in range(len(words) - 9):
            if tuple(words[k : k + 10]) in windows:
                hit |= set(range(k, k + 10))
        if 2 * len(hit) <= len(words):
            spans = []
            for k in sorted(hit):
                if spans and spans[-1][1] == k:
                    spans[-1][1] = k + 1
                else:
                    spans.append([k, k + 1])
            left[i] = secret_scan.masked(decontamination.without_spans(texts[i], spans))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    check_packing(rows, 2048)
    own = packing.Encoder(VOCABULARY)
    wanted = {i: len(own.encode(t)) // 4 + 1 for i, t in left.items()}
    found = Counter()
    for r in rows:
        found[r.doc_id] += r.length
    assert dict(found) == wanted
    assert 0 < len(wanted) < len(texts) < docs.count()


def test_stages_keep_the_columns(spark):
    frame = awkward.frame(spark).union(
        spark.createDataFrame([(50 + i, awkward.LONG + f" {i} " * i, *awkward.rows()[0][2:]) for i in (0, 900)], awkward.SCHEMA)
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.staged(stage(spark, frame, FOLDER))
        assert frame.columns == awkward.frame(spark, []).columns
    assert sorted(r.doc_id for r in frame.collect()) == [6, 56] or {r.doc_id for r in frame.collect()} == {6}
    none = awkward.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_quoting_replies_are_linked(spark):
    rows = queries.QUERIES["quoting_replies"](spark, FOLDER).collect()
    said = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}
    assert len(rows) == len(said)
    linked = [r for r in rows if r.n_linked]
    assert len(linked) > len(rows) / 3
    assert all(r.parent_turn < r.turn for r in linked)
    # Without the quotes every message has its own text again.
    assert all(r.text == (said[r.conv_id, r.turn].text or "").strip(" \t\n\x0b\f\r") for r in rows)
