"""Main texts against pages whose article is known by construction, and against a plain reader of simple pages."""

from __future__ import annotations

import html.parser
import random

import pytest

from duelens.llm import html_extract

LONG = "A long text, with commas, of many words, that goes on and on. " * 6


def section(i: int) -> str:
    return f"Section {i}, has text, with commas, number {i}."


FOUR = "".join(f"<div class=sec><div><p>{section(i)}</p></div></div>" for i in range(4))
ALL_FOUR = " ".join(map(section, range(4)))
UNWANTED = [
    "reader-comments", "commentlist", "user-comment", "post-comments", "google-ad", "article-ad", "side_bar",
    "legal-notice", "gdpr-notice", "alert", "googleAd", "adContainer", "site-header", "top-nav", "sidebar-inner",
    "x newsletter-signup-form subscribe",
]
WANTED = [
    "no-sidebar", "has-cookie-notice", "commentary", "article-header", "entry-header", "content-with-sidebar",
    "headline", "shared-content", "loadmore", "navy", "adsorption", "",
]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><div><div>{FOUR}</div></div></article>", ALL_FOUR),
        (f"<body><nav><a href=x>n</a></nav><div><div>{FOUR}</div></div></body>", ALL_FOUR),
        (f"<body>{FOUR}</body>", ALL_FOUR),
        ("<main><article><p>First, one.</p></article><article><p>Second, two, three.</p></article></main>",
         "First, one. Second, two, three."),
        ("<article><p>First.</p></article><div>Between</div><article><p>Second, two.</p></article>", "First. Second, two."),
        (f"<article><p>The post, short.</p></article><article class='comment-body'><p>{LONG * 3}</p></article>",
         "The post, short."),
        (f"<div class=post><p>The post, itself.</p></div><article class='comment-body'><p>{LONG * 3}</p></article>",
         "The post, itself."),
        ("<main><article><p>A, b, c.</p></article><article class=card><a href=x>Read this other story</a></article></main>",
         "A, b, c."),
        ("<article><p>A, b.</p><p><a href=x>A paragraph that is all link</a></p></article>", "A, b. A paragraph that is all link"),
        (f"<div class=comments><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class=sidebar><div><p>{LONG}</p></div></div><p>x", f"{LONG}x"),
    ],
)
def test_articles_come_whole(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("name", UNWANTED)
def test_unwanted_classes(name):
    page = f"<div id=content><p>{LONG}</p><div class='{name}'><p>Out, of, it, all, here.</p></div></div>"
    assert html_extract.main_text(page) == LONG.strip()


@pytest.mark.parametrize("name", WANTED)
def test_classes_that_only_sound_so(name):
    page = f"<div id=content><p>{LONG}</p><div class='{name}'><p>In it, all, here.</p></div></div>"
    assert html_extract.main_text(page) == LONG + "In it, all, here."


def built(rng: random.Random) -> tuple[str, str]:
    """A random page and the text of its article."""
    words: list[str] = []

    def sentence() -> str:
        some = [rng.choice(["corn,", "mill", "river", "é&amp;u", "&lt;x&gt;", "valley,", "of"]) for _ in range(rng.randint(3, 30))]
        words.extend(w.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">") for w in some)
        glue = rng.choice([" ", "\n ", " <b> </b>", "<br>"])
        return glue.join(some)

    def noise() -> str:
        return rng.choice([
            "<nav><ul><li><a href=/a>menu</a></ul></nav>", "<div class='ad-slot'>buy, buy, buy, buy</div>",
            "<aside><p>beside, it, all</p></aside>", "<form><label>name</label><input></form>",
            "<script>if (a < b) { c('<p>no</p>') }</script>", "<!-- <p>no</p> -->", "<style>p{}</style>",
            "<section class='user-comments'><p>I, say, so, too, here, now</p></section>", "<div hidden>no</div>",
        ])

    def content(depth: int) -> str:
        kind = rng.randint(0, 5)
        if depth and kind < 3:
            tag = rng.choice(["div", "section", "div class=sec", "blockquote"])
            inner = "".join(content(depth - 1) for _ in range(rng.randint(1, 3)))
            return f"<{tag}>{inner}</{tag.split()[0]}>"
        if kind == 3:
            return "<ul>" + "".join(f"<li>{sentence()}" for _ in range(rng.randint(1, 3))) + "</ul>"
        if kind == 4:
            return noise()
        return f"<p>{sentence()}" + rng.choice(["</p>", ""]) + rng.choice(["", noise()])

    body = "".join(content(4) for _ in range(rng.randint(1, 4))) + f"<p>{sentence()}</p>"
    holder = rng.choice(["article", "main", "div id=content"])
    around = "div" if rng.random() < 0.5 else "body"
    page = f"<html><head><title>t</title></head><{around}>{noise()}<{holder}>{body}</{holder.split()[0]}>{noise()}"
    return page + f"<footer>&copy; me</footer></{around}></html>", " ".join(words)


@pytest.mark.parametrize("seed", range(300))
def test_built_pages(seed):
    page, text = built(random.Random(seed))
    assert html_extract.main_text(page) == text


class Plain(html.parser.HTMLParser):
    """Text of the one ``article`` of a well-formed page, but for elements with unwanted tags or classes."""

    OUT = {"nav", "aside", "form", "script", "style", "footer", "button", "noscript", "iframe"}
    CLASSES = {"ad", "ads", "advert", "comments", "comment", "sidebar", "cookie", "banner", "notice", "newsletter", "share", "related", "promo"}
    EMPTY = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attributes):
        if tag not in html_extract.INLINE:
            self.pieces.append(" ")
        if tag not in self.EMPTY:
            classes = set(" ".join(v or "" for k, v in attributes if k in ("class", "id")).split())
            self.open.append((tag, tag in self.OUT or bool(classes & self.CLASSES)))

    def handle_endtag(self, tag):
        if tag not in html_extract.INLINE:
            self.pieces.append(" ")
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not any(out for _, out in self.open):
            self.pieces.append(data)


def test_given_pages_against_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        reader = Plain()
        reader.feed(row.html)
        reader.close()
        assert found[row.page_id] == " ".join("".join(reader.pieces).split())
