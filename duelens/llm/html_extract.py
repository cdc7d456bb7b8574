"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements; what can never be article text (menus, forms, scripts, adverts, comments
and so on, by tag, role or class) is no part of it. A class or id is read part by part (``reader-comments``,
``googleAd``): its last part says what it is and the others of what kind, so ``no-sidebar`` is no
sidebar and ``article-header`` belongs to its article. What is marked as a part of the page's frame (a sidebar, say) stays if it holds the
article or, on pages without one, most of their text; comments and adverts stay only where nothing else is there.

Every paragraph gives its container points for its length and its commas, and every container passes half of its points on
to the one around it, up to the root; a container's points are discounted by the share of its text
that stands in links. The container with most points is the best one. Its article is the outermost ``article`` around it, or itself. From there
up to ``main``, or to the page without one, siblings and the text beside them are kept at each level, unless more than
a quarter of theirs stands in links; beside an ``article`` that is in no ``main``, other articles only. Nothing inside
an article, or inside the best container, is left out.

The tree is read leniently: end tags may be missing, a page may break off anywhere. Pages are read whole, whatever their
length and depth. Ties go to the first container of the page. Null and empty pages, and pages without text, have an
empty text. Rows are treated alike, each for itself, whatever their ids; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from duelens.llm.words import Out, rows_of

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(
    r"([^\s=>/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?"
)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "video", "audio"}
DROPPED = RAW | {
    "head", "nav", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "input",
}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "mstyle", "msub", "msubsup",
    "msup", "mtext", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "semantics", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element of the first kind ends where an element of the second kind begins or ends.
CLOSED_BY = {
    "p": {
        "p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "aside", "main",
        "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "form", "hr", "figure", "figcaption", "address", "details",
    },
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
#: What an element is: of these, an element is no article text whatever its kind (reader-comments, google-ad).
_NEVER = (
    r"comments?|commentlist|commentform|commentbox|disqus|replies|respond|ads?|advert\w*|adsense|adsbygoogle|sponsor(?:ed|s)?"
    r"|promos?|promotions?|cookies?|consent|gdpr|newsletters?|subscribe|subscription|paywall|popups?|modals?|notices?|alerts?"
    r"|share|sharing|sharebar|social|related|breadcrumbs?|sidebars?|pagination|pager"
)
#: These belong to the page unless their kind says otherwise (site-header, but entry-header).
_FRAME = r"header|footer|masthead|menus?|nav|navbar|navigation|banner|widgets?|toolbar|topbar"
#: Kinds that say where or in what form something stands, not what it is.
_NEUTRAL = (
    r"site|page|global|main|primary|secondary|top|bottom|left|right|inner|outer|container|wrapper|wrap|box|bar|area"
    r"|block|section|list|item|items|link|links|button|buttons|posts|slot|unit|form|div|body|row|col|mobile|desktop|holder|\d+"
)
#: Before these a part says what an element does not have, or has beside other things.
_NEGATING = r"no|not|non|has|have|with|without|hide|hidden|show|is|pre|before|after|if|until|load|loaded|open|closed|can"
NEVER, FRAME, NEUTRAL, NEGATING = (
    re.compile(f"(?:{words})") for words in (_NEVER, _FRAME, _NEUTRAL, _NEGATING)
)
_PART = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
WANTED = {"article", "main"}


class Element:
    """An element: its children (elements and text runs), and what it holds of text, links and commas."""

    __slots__ = ("tag", "parent", "block", "children", "marked", "points", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        #: Itself, or the nearest element around it that isn't part of a line of text.
        self.block: Element = parent.block if parent is not None and tag in INLINE else self
        self.children: list[Element | str] = []
        #: By its attributes it is none of the article's text: 'never', or 'frame' unless it holds that.
        self.marked = ""
        self.points = 0.0
        self.chars = self.linked = self.commas = 0


def kind_of(token: str) -> str:
    """'never', 'frame' or '' for one token of a class or id."""
    parts = [p.lower() for p in _PART.findall(_HUMP.sub("-", token))]
    joined = "".join(parts)
    if joined in ("sidebar", "rightsidebar", "leftsidebar"):
        return "frame"
    while len(parts) > 1 and NEUTRAL.fullmatch(parts[-1]):
        parts.pop()
    if not parts or any(NEGATING.fullmatch(p) for p in parts[:-1]):
        return ""
    if NEVER.fullmatch(parts[-1]):
        # A sidebar or a notice may be the frame of a page, comments and adverts are not.
        return "frame" if re.fullmatch(r"sidebars?|related|notices?|alerts?|social|modals?", parts[-1]) else "never"
    others = [p for p in parts[:-1] if not NEUTRAL.fullmatch(p)]
    if FRAME.fullmatch(parts[-1]) and all(NEVER.fullmatch(p) or FRAME.fullmatch(p) for p in others):
        return "frame"
    return ""


def _marked(attributes: str) -> str:
    """Whether an element's attributes say that it is left out with all that it holds: as 'never' or 'frame'."""
    found = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            kinds = set(map(kind_of, value.split()))
            if "never" in kinds:
                return "never"
            found = "frame" if "frame" in kinds else found
        if name == "role" and value.lower() in ROLES:
            found = "frame"
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "never"
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return "never"
    return found


def parsed(page: str) -> Element:
    """The page's tree without elements that are left out."""
    root = Element("", None)
    here, at = root, 0
    opened: Counter[str] = Counter()
    left_out: list[str] = []
    position = 0

    def add(text: str) -> None:
        if text and not left_out:
            here.children.append(html.unescape(text))

    def closed(node: Element) -> Element:
        opened[node.tag] -= 1
        return node.parent

    while match := MARKUP.search(page, position):
        add(page[at : match.start()])
        at = position = match.end()
        closing, tag, attributes = match[1], (match[2] or "").lower(), match[3] or ""
        if not tag:
            continue
        if left_out:
            if closing and tag in left_out:
                while left_out.pop() != tag:
                    pass
            elif not closing and tag not in VOID and tag == left_out[0]:
                left_out.append(tag)
            elif closing and opened[tag]:
                left_out.clear()
            if left_out or not (closing and opened[tag]):
                continue
        if closing:
            if opened[tag]:
                while here.tag != tag:
                    here = closed(here)
                here = closed(here)
            continue
        while tag in CLOSED_BY.get((block := here.block).tag, ()):
            while here is not block:
                here = closed(here)
            here = closed(here)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, position)
            at = position = end.end() if end else len(page)
        elif tag in VOID:
            here.children.append(" " if tag in ("br", "hr") else "")
        elif tag in DROPPED or (tag == "header" and not any(opened[t] for t in WANTED)):
            if not attributes.endswith("/"):
                left_out.append(tag)
        else:
            node = Element(tag, here)
            if attributes and tag not in ("html", "body"):
                node.marked = _marked(attributes)
            here.children.append(node)
            here = node
            opened[tag] += 1
    add(page[at:])
    _leave_out(root)
    return root


def _elements(root: Element) -> list[Element]:
    """All elements, each before those that it holds."""
    found = [root]
    for node in found:
        found += [c for c in node.children if isinstance(c, Element)]
    return found


def _leave_out(root: Element) -> None:
    """Take marked elements out: comments and adverts unless all text is in them, parts of the frame unless they
    hold an article or, without one, most of the text."""
    nodes = _elements(root)
    if not any(node.marked for node in nodes):
        return
    if _chars(nodes, "never")[root]:
        _prune(root, lambda c: c.marked == "never")
        nodes = _elements(root)
    chars = _chars(nodes)
    holders: set[Element] = set()
    for node in reversed(nodes):
        if node in holders or (node.tag in WANTED and not node.marked and chars[node]):
            holders.add(node.parent)
    whole, articles = chars[root], bool(holders)
    _prune(
        root,
        lambda c: c.marked
        and c not in holders
        and (articles or c.tag not in WANTED)
        and (articles or 2 * chars[c] <= whole),
    )


def _chars(nodes: list[Element], without: str | None = None) -> dict[Element, int]:
    """Characters of text in each element, but for what is in elements marked so."""
    chars: dict[Element, int] = {}
    for node in reversed(nodes):
        chars[node] = 0 if without and node.marked == without else sum(
            len(" ".join(c.split())) if isinstance(c, str) else chars[c] for c in node.children
        )
    return chars


def _prune(root: Element, goes: Callable[[Element], object]) -> None:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not goes(c)]
        waiting += [c for c in node.children if isinstance(c, Element)]


def _commas(text: str) -> int:
    return text.count(",") + text.count("،") + text.count("、")


def scored(root: Element) -> list[Element]:
    """Give all containers their points; the elements, outermost first."""
    nodes = _elements(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(" ".join(child.split()))
                node.commas += _commas(child)
            else:
                node.chars += child.chars
                node.commas += child.commas
                node.linked += child.chars if child.tag == "a" else child.linked
    for node in nodes:
        if node.tag in INLINE or node.parent is None:
            continue
        lines = [c for c in node.children if isinstance(c, str) or c.tag in INLINE]
        chars = sum(len(" ".join(c.split())) if isinstance(c, str) else c.chars for c in lines)
        if chars:
            commas = sum(_commas(c) if isinstance(c, str) else c.commas for c in lines)
            holder = node.parent.block if node.tag in PARAGRAPHS else node
            holder.points += 1 + commas + min(chars / 100, 3)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.block.points += node.points / 2
    for node in nodes:
        node.points *= 1 - node.linked / max(node.chars, 1)
        if node.tag in WANTED:
            node.points = node.points * 2 + 1
    return nodes


def article(root: Element) -> Element | None:
    """The element that holds the article, without what stands in it beside the article; none without text."""
    containers = [n for n in scored(root) if n.chars and n.tag not in INLINE]
    if not containers:
        return None
    best = max(containers, key=lambda n: n.points)
    around = [best]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    tags = [n.tag for n in around]
    last = len(tags) - 1
    if "article" in tags:
        best = around[last - tags[::-1].index("article")]
    if "main" in tags:
        last -= tags[::-1].index("main")
    beside_articles = best.tag == "article" and "main" not in tags
    for node in around[around.index(best) + 1 : last + 1]:
        node.children = _kept(node.children, best, beside_articles)
        best = node
    return best


def _kept(children: list[Element | str], best: Element, articles: bool) -> list[Element | str]:
    """``best`` and its siblings that belong to it: with little text in links, or only those that hold articles."""
    kept: list[Element | str] = []
    for in_line, group in groupby(children, lambda c: isinstance(c, str) or c.tag in INLINE):
        held = list(group)
        for some in [held] if in_line and best not in held else [[c] for c in held]:
            chars = sum(len(" ".join(c.split())) if isinstance(c, str) else c.chars for c in some)
            linked = sum(
                0 if isinstance(c, str) else c.chars if c.tag == "a" else c.linked for c in some
            )
            wanted = not articles or any(_holds_article(c) for c in some)
            if some == [best] or (wanted and chars and linked * 4 <= chars):
                kept += some
    return kept


def _holds_article(item: Element | str) -> bool:
    return isinstance(item, Element) and any(n.tag == "article" for n in _elements(item))


def text_of(parts: list[Element | str]) -> str:
    """Their text: white space as single spaces, blocks joined by a space."""
    pieces: list[str] = []
    waiting: list[Element | str] = list(reversed(parts))
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        if item.tag in INLINE:
            waiting += reversed(item.children)
        else:
            waiting += [" ", *reversed(item.children), " "]
    return " ".join("".join(pieces).split())


def main_text(page: str | None) -> str:
    held = article(parsed(page)) if page else None
    return text_of([held]) if held is not None else ""


def _text_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
    )
    out = Out(schema)
    for page_id, url, page in rows_of(batches):
        text = main_text(page)
        if out.add(page_id, url, text, len(text), size=len(text)):
            yield out.batch()
    yield out.batch()


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    rows = pages.selectExpr("CAST(page_id AS long) AS page_id", "url", "html")
    return rows.mapInArrow(_text_rows, "page_id long, url string, text string, n_chars long")
