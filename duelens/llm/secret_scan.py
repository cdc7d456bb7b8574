"""Secret scans through nested encodings.

A document is the first layer of a worklist. Each layer is scanned; then it is unwrapped: all URL
escapes at once, all Unicode and octal escapes and character references at once, each base64 run by itself (UTF-8 or UTF-16), and bytes that begin
like gzip, zlib, bzip2 or zstd data are decompressed. What comes out is a new layer that remembers for
each character where in the document it came from, and joins the worklist unless the
same text has been there before. A base64 run may be wrapped: lines of one width, the last one shorter and the
first one of any width (it may have a name or a path before it), are one run without their line breaks,
which may also be written as ``\\n`` and be followed by indentation. A run that is no clean text
as a whole is read at all four alignments for readable parts and for compressed data that begin
inside it, because other letters may touch the base64. The list is empty when nothing unwraps any further; layers
that lead back to themselves end the same way.

A null text is an empty text: no spans. Ties are ordered by start, kind and end; equal spans from several
layers are one span. Rows are treated alike, each for itself, whatever their ids or other
columns.

Compressed data are read in pieces, all members one after another, and directly nested ones until nothing
unpacks. Their text is scanned in parts that end at characters that no secret and no encoding can
have, so nothing lies across two parts. At most ``HELD_BYTES`` of a level are kept; what is larger is unpacked
again where it is needed. Larger texts in URL escapes are layers of their own, in such parts, the first and the last with the
text around the escapes.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from html.entities import html5
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelens.llm.words import Out, rows_of

HELD_BYTES = 16 << 20
PIECE = 1 << 20
KINDS = ("assign", "access", "hex")
MASK = "[secret]"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
URL_RUN = re.compile("(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
    r"|\\u\{([0-9A-Fa-f]{1,6})\}|%u([0-9A-Fa-f]{4})|\\([0-3][0-7]{2})|(&[A-Za-z][A-Za-z0-9]{1,31};)"
)
#: Number base of the digits of each group; the last one is a named character reference.
BASES = (16, 16, 16, 16, 10, 16, 16, 8, 0)
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
LINE_BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|(?:\\++r)?\\++n)[ \t]*+")
BASE64_LINES = re.compile(
    rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{LINE_BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}"
)
LEAST_RUN = 20
#: No secret, and no encoding of one, is shorter or has other characters.
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
COMPRESSED = re.compile(rb"(?=\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\x28\xb5\x2f\xfd)")

#: In no secret and no encoding of one, and left alone by all of them.
APART = re.compile(r"[^ \t\r\nA-Za-z0-9+/_.=:'\"%\\&#;-]")
PACK_ERRORS = (zlib.error, OSError, ValueError, EOFError, zstandard.ZstdError)

Span = tuple[int, int, int]  # start, place of the kind, end


class Layer:
    """A text and, for each character, the [start, end) of the document it stands for."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return min(self.starts[start:end]), max(self.ends[start:end])


def scan(text: str) -> list[Span]:
    """Secrets of one layer: leftmost, not overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _pieces(data: bytes | memoryview) -> Iterator[bytes]:
    for at in range(0, len(data), PIECE):
        yield bytes(data[at : at + PIECE])


def _unpacker(head: bytes):
    """An object that unpacks gzip, zlib, bzip2 or zstd data; nothing for other data."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and int.from_bytes(head[:2]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _step(unpacker, data: bytes) -> tuple[bytes, bytes]:
    """Some unpacked bytes, and the data still to be given."""
    if isinstance(unpacker, bz2.BZ2Decompressor):
        part = unpacker.decompress(data, PIECE)
        return part, unpacker.unused_data if unpacker.eof else b""
    if isinstance(unpacker, type(zlib.decompressobj())):
        part = unpacker.decompress(data, PIECE)
        return part, unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
    # zstd has no bound for the result: 64 bytes hold at most 16 blocks of 128 KiB
    part = unpacker.decompress(data[:64])
    return part, (unpacker.unused_data if unpacker.eof else b"") + data[64:]


def _unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What packed data hold, member after member; one that breaks off ends there.

    Raises one of ``PACK_ERRORS`` if the first member is broken; broken later members and other data end it.
    """
    data, first = b"", True
    while True:
        data = data if first else data.lstrip(b"\0")
        while len(data) < 4 and (more := next(pieces, b"")):
            data += more
        unpacker = _unpacker(data[:4])
        if unpacker is None:
            return
        try:
            while not unpacker.eof:
                part, data = _step(unpacker, data)
                if part:
                    yield part
                elif not data:
                    data = next(pieces, b"")
                    if not data:
                        return
        except PACK_ERRORS:
            if first:
                raise
            return
        first = False


Reader = Callable[[], Iterator[bytes]]


def opened(data: bytes | memoryview) -> Reader | None:
    """Reads what packed data hold in the end; nothing for other or broken data."""
    read: Reader = partial(_pieces, data)
    found, seen = None, set()
    while _unpacker(next(read(), b"")[:4]) is not None:
        below: Reader = partial(lambda above: _unpacked(above()), read)
        held, many, digest = [], 0, hashlib.sha256()
        try:
            for part in below():
                many += len(part)
                digest.update(part)
                if many <= HELD_BYTES:
                    held.append(part)
        except PACK_ERRORS:
            break
        if not many or digest.digest() in seen:
            break
        seen.add(digest.digest())
        found = read = partial(_pieces, b"".join(held)) if many <= HELD_BYTES else below
    return found


def clean(data: bytes) -> str | None:
    """Bytes as text, if they are clean UTF-8."""
    return next(texts(partial(iter, [data]), whole=True), None)


def wide(data: bytes) -> str | None:
    """UTF-16 bytes as text, if they are clean: with a mark, or every other byte is zero."""
    if len(data) < 8 or len(data) % 2:
        return None
    order = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(bytes(data[:2]))
    if order is None:
        zeros = [data[i::2].count(0) for i in (0, 1)]
        if max(zeros) * 4 < len(data) or min(zeros) * 8 > len(data):
            return None
        order = "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
    try:
        text = data.decode(order)
    except UnicodeDecodeError:
        return None
    return text if _odd(text) * 10 <= len(text) else None


def _odd(text: str) -> int:
    text = text.translate({9: None, 10: None, 13: None})
    return 0 if text.isprintable() else sum(not c.isprintable() for c in text)


def texts(read: Reader, whole: bool = False) -> Iterator[str]:
    """Clean UTF-8 as text, in parts that can be scanned one by one or as a whole; nothing otherwise."""
    many = odd = 0
    try:
        for text in codecs.iterdecode(read(), "utf-8"):
            many += len(text)
            odd += _odd(text)
    except UnicodeDecodeError:
        return
    if not many or odd * 10 > many:
        return
    held: list[str] = []
    for text in codecs.iterdecode(read(), "utf-8"):
        last = None if whole else APART.search(text[::-1])
        if last:
            cut = len(text) - last.start()
            yield "".join([*held, text[:cut]])
            held = [text[cut:]]
        else:
            held.append(text)
    if any(held):
        yield "".join(held)


def _url_data(match: re.Match) -> bytes:
    return binascii.unhexlify(match[0].replace("%", ""))


def _url(match: re.Match) -> str | None:
    data = _url_data(match)
    read = opened(data)
    if read is None:
        return clean(data)
    return next(texts(read, whole=True), None) if _is_held(read) else None


def _is_held(read: Reader) -> bool:
    return read.func is _pieces


def _large_url(layer: Layer) -> Iterator[Layer]:
    """Texts that are too large to be put in the place of their URL escapes, part by part: the first and the last
    part go with the text around the escapes, up to characters that no secret has."""
    for match in URL_RUN.finditer(layer.text):
        read = opened(_url_data(match))
        if read is None or _is_held(read):
            continue
        start, end = match.span()
        apart = APART.search(layer.text[:start][::-1])
        held = _part(layer, start - apart.start() if apart else 0, start)
        last = False
        for text in texts(read):
            if last:
                yield held
                held = Layer("", [], [])
            held, last = _joined(held, _covering(layer, text, range(start, end))), True
        apart = APART.search(layer.text, end)
        yield _joined(held, _part(layer, end, apart.start() if apart else len(layer.text)))


def _part(layer: Layer, start: int, end: int) -> Layer:
    return Layer(layer.text[start:end], layer.starts[start:end], layer.ends[start:end])


def _joined(left: Layer, right: Layer) -> Layer:
    return Layer(
        left.text + right.text, [*left.starts, *right.starts], [*left.ends, *right.ends]
    )


def _escaped(match: re.Match) -> str | None:
    digits, base = next((g, b) for g, b in zip(match.groups(), BASES, strict=True) if g)
    if not base:
        return html5.get(digits[1:])
    value = int(digits, base)
    return chr(value) if 0 < value < 0x110000 and not 0xD800 <= value < 0xE000 else None


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable) -> Layer | None:
    """The layer with every match that decodes replaced by what it stands for."""
    parts, starts, ends, at = [], [], [], 0
    for match in pattern.finditer(layer.text):
        text = decode(match)
        if text is None:
            continue
        start, end = match.span()
        parts += [layer.text[at:start], text]
        starts += layer.starts[at:start]
        ends += layer.ends[at:start]
        if pattern is URL_RUN and text.isascii() and 3 * len(text) == end - start:
            for i in range(start, end, 3):
                first, last = layer.span(i, i + 3)
                starts.append(first)
                ends.append(last)
        else:
            first, last = layer.span(start, end)
            starts += [first] * len(text)
            ends += [last] * len(text)
        at = end
    if not parts:
        return None
    starts += layer.starts[at:]
    ends += layer.ends[at:]
    return Layer("".join([*parts, layer.text[at:]]), starts, ends)


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _placed(
    layer: Layer, text: str, places: list[int] | range, at: int, width: int = 1
) -> Layer:
    """``text`` of ``width`` bytes a character, decoded from byte ``at`` on of a run whose characters
    stand at ``places``."""
    here = range(at, at + len(text) * width, width)
    starts = [layer.starts[places[i * 4 // 3]] for i in here]
    ends = [
        max(layer.ends[q] for q in places[i * 4 // 3 : (8 * (i + width) - 1) // 6 + 1]) for i in here
    ]
    return Layer(text, starts, ends)


def _covering(layer: Layer, text: str, places: list[int] | range) -> Layer:
    """``text`` whose characters all stand for the whole run."""
    first, last = layer.span(places[0], places[-1] + 1)
    return Layer(text, [first] * len(text), [last] * len(text))


def _whole(
    layer: Layer, places: list[int] | range, run: str
) -> tuple[bool, Iterator[Layer]] | None:
    """What a run holds as a whole, and whether every character has its own place."""
    data = _decoded(run)
    if data is None:
        return None
    read = opened(data)
    if read is None:
        text = wide(data)
        if text is not None:
            plain = all(ord(c) < 0x10000 for c in text)
            held = _placed(layer, text, places, 0, 2) if plain else _covering(layer, text, places)
            return plain, iter([held])
        text = clean(data)
        if text is None:
            return None
        if text.isascii():
            return True, iter([_placed(layer, text, places, 0)])
        return False, iter([_covering(layer, text, places)])
    parts = texts(read)
    first = next(parts, None)
    if first is None:
        return None
    return False, (_covering(layer, text, places) for text in chain([first], parts))


def _inside(layer: Layer, places: list[int] | range, run: str) -> Iterator[Layer]:
    """What parts of a run hold, wherever they begin and end."""
    run = run.rstrip("=")
    for shift in range(4):
        many = len(run) - shift
        data = _decoded(run[shift : len(run) - (many % 4 == 1)])
        if data is None:
            continue
        view, behind = memoryview(data), places[shift:]
        for match in READABLE.finditer(data):
            yield _placed(layer, match[0].decode(), behind, match.start())
        for match in COMPRESSED.finditer(data):
            if match.start() % 3:
                continue
            read = opened(view[match.start() :])
            if read is not None:
                places_here = behind[match.start() // 3 * 4 :]
                yield from (_covering(layer, text, places_here) for text in texts(read))


def _wrapped(text: str) -> Iterator[list[list[tuple[int, int]]]]:
    """Lines that may be one run: several readings of the same lines, the widest first."""
    for block in BASE64_LINES.finditer(text):
        lines, at = [], block.start()
        for cut in LINE_BREAK.finditer(text, *block.span()):
            lines.append((at, cut.start()))
            at = cut.end()
        lines.append((at, block.end()))
        widths = [end - start for start, end in lines]
        first = 0
        while first < len(lines):
            last = first + 1
            while last < len(lines) and widths[last] == widths[first]:
                last += 1
            tail = last + (last < len(lines) and widths[last] < widths[first])
            head = max(first - 1, 0)
            readings = dict.fromkeys([(head, tail), (first, tail), (head, last), (first, last)])
            found = [
                lines[i:j] for i, j in readings if j - i > 1 and sum(widths[i:j]) >= LEAST_RUN
            ]
            if found:
                yield found
            first = last


def _base64(layer: Layer) -> Iterator[Layer]:
    text, read = layer.text, set()
    for readings in _wrapped(text):
        for lines in readings:
            places = [i for start, end in lines for i in range(start, end)]
            below = _whole(layer, places, "".join(text[i:j] for i, j in lines))
            if below:
                exact, layers = below
                yield from layers
                if exact:
                    read |= {end for _, end in lines}
                break
        if not below or lines is not readings[0]:
            places = [i for start, end in readings[0] for i in range(start, end)]
            yield from _inside(layer, places, "".join(text[i:j] for i, j in readings[0]))
    for match in BASE64_RUN.finditer(text):
        if match.end() in read:
            continue
        places = range(*match.span())
        below = _whole(layer, places, match[0])
        if below:
            yield from below[1]
        else:
            yield from _inside(layer, places, match[0])


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly below."""
    if "%" in layer.text:
        if below := _replaced(layer, URL_RUN, _url):
            yield below
        yield from _large_url(layer)
    if ("\\" in layer.text or "&" in layer.text or "%u" in layer.text) and (
        below := _replaced(layer, ESCAPE, _escaped)
    ):
        yield below
    yield from _base64(layer)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the document itself, and those of all its layers, both in order."""
    base = sorted(scan(text))
    found, seen = set(base), set()
    top = Layer(text, range(len(text)), range(1, len(text) + 1))
    waiting = [unwrapped(top)]
    seen.add(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    while waiting:
        layer = next(waiting[-1], None)
        if layer is None:
            waiting.pop()
            continue
        mark = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest()
        mark += hashlib.sha256(repr((layer.starts[:1], layer.ends[-1:])).encode()).digest()
        if mark[:32] in seen or mark in seen:
            continue
        seen.add(mark)
        for start, kind, end in scan(layer.text):
            first, last = layer.span(start, end)
            found.add((first, kind, last))
        waiting.append(unwrapped(layer))
    return base, sorted(found)


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_SCANNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
    ]
)


def _scan_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(_SCANNED)
    for doc_id, text in rows_of(batches):
        base, spans = all_spans(text or "")
        counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
        digest = hashlib.sha256(named(base).encode()).hexdigest()
        if out.add(doc_id, *counts, digest, named(spans)):
            yield out.batch()
    yield out.batch()


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts of the text itself, all spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _scan_rows,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def masked(text: str) -> str:
    """``text`` with every span, its own and those of hidden layers, replaced by ``MASK``."""
    parts, at = [], 0
    for start, _, end in all_spans(text)[1]:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _mask_rows(at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v and masked(v) for v in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked; all rows and columns stay."""
    return docs.mapInArrow(_mask_rows(docs.columns.index("text")), docs.schema)
