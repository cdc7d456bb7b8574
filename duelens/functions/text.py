"""String expressions: slugs, titles, keys and URLs."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest identifier the register's table can hold, the title
# length shown in full, and the text shown when a study has no title.
IDENTIFIER_LENGTH = 63
TITLE_LENGTH = 200
NO_TITLE = "No Title"

_ASCII_ONLY = r"^[\x00-\x7F]*$"
_SPACE = r"[\s\x1c-\x1f]"


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """ASCII remainders of compatibility decomposition, for every code point that has one.

    Decomposition works character by character and the combining marks it splits
    off are never ASCII, so a table by character gives the exact result.
    """
    single_from, single_to, longer = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        ascii_part = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(ascii_part) == 1:
            single_from.append(char)
            single_to.append(ascii_part)
        elif ascii_part:
            longer[char] = ascii_part
    return "".join(single_from), "".join(single_to), longer


def fold_to_ascii(text: Column) -> Column:
    """Decompose (NFKD) and keep what is ASCII: 'Médicament' -> 'Medicament'."""
    single_from, single_to, longer = _ascii_folds()
    longer_map = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    translated = F.translate(text, single_from, single_to)
    by_char = F.transform(
        F.regexp_extract_all(translated, F.lit("(?s)."), F.lit(0)),
        lambda c: F.when(c.rlike(_ASCII_ONLY), c).otherwise(
            F.coalesce(F.element_at(longer_map, c), F.lit(""))
        ),
    )
    return (
        F.when(text.rlike(_ASCII_ONLY), text)
        .when(translated.rlike(_ASCII_ONLY), translated)
        .otherwise(F.array_join(by_char, ""))
    )


def web_slug(text: Column) -> Column:
    """Slug used in addresses and as the sponsor key: 'Lilly S.A' -> 'lilly-sa'."""
    kept = F.regexp_replace(fold_to_ascii(text), r"[^\w\s\x1c-\x1f-]", "")
    trimmed = F.regexp_replace(kept, f"^{_SPACE}+|{_SPACE}+$", "")
    return F.regexp_replace(F.lower(trimmed), r"[\s\x1c-\x1f-]+", "-")


def identifier_slug(text: Column) -> Column:
    """Slug used for record field names: 'E-mail: (work)' -> 'e_mail_work'."""
    words = F.regexp_replace(text, r"(?U)[\W_]+", "_")
    return F.left(F.lower(F.trim(words, F.lit("_"))), F.lit(IDENTIFIER_LENGTH))


def without_line_breaks(text: Column) -> Column:
    """Remove carriage returns and line feeds (no space is put in)."""
    return F.translate(text, "\r\n", "")


def null_if_nan_text(text: Column) -> Column:
    """The text 'nan' left behind by a CSV round trip means missing."""
    return F.nullif(text, F.lit("nan"))


def display_title(full: Column, abbreviated: Column, length: int = TITLE_LENGTH) -> Column:
    """Full title, cut with '...'; the abbreviated one when missing; then a fixed text."""
    return (
        F.when(full.isNull(), F.coalesce(abbreviated, F.lit(NO_TITLE)))
        .when(F.length(full) > length, F.concat(F.substring(full, 1, length), F.lit("...")))
        .otherwise(full)
    )


def last_path_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def composite_key(number: Column, url: Column) -> Column:
    """Record key: study number, '-', last segment of the page address."""
    return F.concat_ws("-", number, last_path_segment(url))


def _without_dot_segments(path: Column) -> Column:
    """Resolve '.' and '..' in an absolute path."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    trailing = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    resolved = F.concat(F.lit("/"), F.array_join(F.concat(kept, trailing), "/"))
    return F.when(path.contains("/."), resolved).otherwise(path)


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against the address of its page (RFC 3986, section 5.2)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_no_fragment = F.regexp_replace(base, r"#.*$", "")
    base_no_query = F.regexp_replace(base_no_fragment, r"\?.*$", "")
    base_path = F.regexp_replace(base_no_query, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    merged = F.when(href_path.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(base_no_fragment, href))
        .when(href.startswith("?"), F.concat(base_no_query, href))
        .otherwise(F.concat(origin, _without_dot_segments(merged), href_rest))
    )


# Ends and rests of a text as Java's patterns have them: a dot stands for no line break, and a
# last line break may follow the end.
_END = r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)"
_REST = r"[^\n\r\x85\u2028\u2029]*"
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_ORIGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*")
_BEFORE_PATH = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*")
_FRAGMENT, _QUERY = (re.compile(rf"{mark}{_REST}{_END}") for mark in (r"#", r"\?"))
_HREF_REST = re.compile(rf"[^?#]*({_REST}){_END}")
_DOTS_AT_END = re.compile(rf"/\.\.?{_END}")


def resolved_url(base: str | None, href: str | None) -> str | None:
    """``absolute_url`` of two texts."""
    if href is None:
        return None
    if _SCHEME.match(href):
        return href
    if base is None:
        return None
    if href == "":
        return base
    scheme = _SCHEME.match(base)
    if href.startswith("//"):
        return f"{scheme[1] if scheme else ''}:{href}"
    whole = _FRAGMENT.sub("", base)
    if href.startswith("#"):
        return whole + href
    whole = _QUERY.sub("", whole)
    if href.startswith("?"):
        return whole + href
    origin, rest = _ORIGIN.match(base), _HREF_REST.match(href)
    path = re.split(r"[?#]", href, maxsplit=1)[0]
    if not path.startswith("/"):
        folder = _BEFORE_PATH.sub("", whole, count=1) if _BEFORE_PATH.match(whole) else whole
        path = (folder[: folder.rfind("/") + 1] or "/") + path
    if "/." in path:
        kept: list[str] = []
        for segment in path.split("/")[1:]:
            if segment == "..":
                del kept[-1:]
            elif segment != ".":
                kept.append(segment)
        path = "/" + "/".join([*kept, ""] if _DOTS_AT_END.search(path) else kept)
    return f"{origin[0] if origin else ''}{path}{rest[1] if rest else ''}"
