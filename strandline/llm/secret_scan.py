"""Secrets in texts, also below layers of encoding.

A worklist starts with the text itself.  Each layer is scanned with the base
patterns; then every decoder (URL escapes, Unicode escapes, base64, compressed
data below one of these, and compressed data in compressed data) adds the layers it can unwrap.  Every character of a
layer knows the code points of the original text it came from, so each finding
maps back to a span there.  A layer already seen at the same place ends a cycle;
the list runs until nothing new turns up.  Inflated data is scanned in pieces, so
that a small text that inflates a thousandfold needs no more memory.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_of

# The base patterns and the least lengths of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # whole runs of 16 and more

WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Characters of a piece of inflated data, and how far two pieces overlap at least.
PIECE, OVERLAP = 1 << 22, 1 << 12
#: Characters of coded data: a piece does not end inside a run of them.
_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.%\\-{}&#;\r\n"
#: Shortest run that is tried as base64.
BASE64_LEAST = 20

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
#: Whole tokens of coded bytes, literal characters included, that have a code.
_URL_CODE = re.compile("%([0-9A-Fa-f]{2})")
_URL_TOKEN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+!'()*;,?:@&=$#-])++")
_ESCAPE_CODE = re.compile(r"""\\(?:(?:x|u00)([0-9A-Fa-f]{2})|[abfnrtv0'"\\/])""")
_ESCAPE_TOKEN = re.compile(r"""(?:\\(?:x|u00)[0-9A-Fa-f]{2}|\\[abfnrtv0'"\\/]|[\x20-\x5b\x5d-\x7e])++""")
_BINARY_URL = re.compile("%[0189A-Fa-f][0-9A-Fa-f]")
_SHORT = {"\\a": 7, "\\b": 8, "\\f": 12, "\\n": 10, "\\r": 13, "\\t": 9, "\\v": 11, "\\0": 0}
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{BASE64_LEAST},}}={{0,2}}")
#: Lines of nothing but base64, the first and the last of which may share theirs with other text; a break may be written as a code.
_BREAK = re.compile(r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>#*]*+")
_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)+")
#: Stretches among other bytes that can hold a finding: all patterns and codes are ASCII, and none is shorter.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")

Span = tuple[str, int, int]


class Layer:
    """A text and, per character, the original code points it stands for (None: itself)."""

    __slots__ = ("text", "low", "high")

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.text, self.low, self.high = text, low, high

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.low is None:
            return start, end
        return int(self.low[start:end].min()), int(self.high[start:end].max())


def scan(text: str) -> Iterator[Span]:
    """Base findings: kind, start, end, leftmost and not overlapping within a kind."""
    lower = text.lower()
    if any(w in lower for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


# -- decoders -------------------------------------------------------------------
_BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)
#: The bytes of a head that tell what kind of stream begins.
_HEAD = 6
#: No stream has fewer bytes.
_STREAM_LEAST = 8
#: First bytes of a stream by which one that holds itself is known.
_MARKED = 1 << 16
_ZLIB = b"|".join(
    b"\\x%02x[%s]" % (c, b"".join(b"\\x%02x" % f for f in range(256) if (c << 8 | f) % 31 == 0)) for c in range(0x08, 0x80, 0x10)
)
_MAGIC = re.compile(rb"(?=\x1f\x8b|BZh|\xfd7zXZ\x00|%s)" % _ZLIB, re.DOTALL)


def _opened(head: bytes):
    """A decompressor for a stream that begins so, None if none does."""
    if not _MAGIC.match(head):
        return None
    if head[:1] == b"\x1f":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:1] == b"\xfd" else zlib.decompressobj()


def _step(opened, data: bytes) -> tuple[bytes, bytes | None]:
    """(at most a piece of output, what is left to put in; None if nothing is to come without more data)."""
    part = opened.decompress(data, PIECE)
    if opened.eof:
        return part, opened.unused_data
    left = getattr(opened, "unconsumed_tail", b"")
    return part, left if left or part else None


def _extent(raw: memoryview) -> tuple[int, bool]:
    """Length of the streams that ``raw`` begins with, one after the other (0: none), and whether the last one ends."""
    at, size = 0, len(raw)
    while (opened := _opened(bytes(raw[at : at + _HEAD]))) is not None:
        left, made = raw[at:], False
        try:
            while left is not None and not opened.eof:
                part, left = _step(opened, left)
                made |= bool(part)
        except _BROKEN:
            return (size, False) if made else (at, True)
        if not opened.eof:
            return (size, False) if made else (at, True)
        at = size - len(left)
        left = left.lstrip(b"\0")  # padding
        if _opened(left[:_HEAD]) is None:
            break
        at = size - len(left)
    return at, True


def _streams(raw: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of the compressed streams in ``raw``; those that follow each other are one."""
    at = 0
    while (m := _MAGIC.search(raw, at)) is not None:
        n, ends = _extent(memoryview(raw)[m.start() :])
        if n:
            yield m.start(), m.start() + n
        at = m.start() + (n if n and ends else 1)


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return text if text and odd * 20 <= len(text) else None


class _Data:
    """Bytes of one level: what is at hand, the stream that is read, the data below it and text not yet given out."""

    __slots__ = ("buf", "at", "done", "last", "stream", "start", "fed", "made", "below", "end", "text", "fresh", "marks")

    def __init__(self, marks: frozenset = frozenset(), text: bool = True):
        self.buf, self.at, self.done, self.last = bytearray(), 0, 0, False
        self.stream, self.start, self.fed, self.made = None, 0, 0, 0
        self.below, self.end = None, 0
        self.text, self.fresh, self.marks = bytearray() if text else None, 0, marks


def _inflated(raw: bytes) -> Iterator[str]:
    """Texts below compressed bytes, in overlapping pieces, whatever streams are in each other or in a row.

    Streams are looked for at every byte of every level, but for the insides of
    streams that end well.  Those that follow each other (zeros may lie between) hold
    one data; so does one that breaks off, up to there, and its bytes are searched
    again.  What no stream covers is text.  Levels are read in pieces; only the bytes of an unfinished stream
    and an unfinished run of code characters are held.
    """
    work, seen = [(_take, _Data(text=False), raw, True)], set()
    while work:
        do, *args = work.pop()
        yield from do(work, seen, *args)


def _take(work, seen, level: _Data, data: bytes, last: bool) -> Iterator[str]:
    """More data of a level; ``last``: none will follow."""
    level.buf += data
    level.last |= last
    if level.stream is not None or level.last or len(level.buf) >= PIECE:
        work.append((_search, level))
    if level.stream is not None:
        work.append((_feed, level, b""))
    yield from ()


def _search(work, seen, level: _Data) -> Iterator[str]:
    """The next place where a stream may begin."""
    if level.stream is not None:
        return
    size = len(level.buf)
    stop = size if level.last else max(size - _MARKED, level.at)
    found = _MAGIC.search(level.buf, level.at)
    place = found.start() if found and found.start() < stop else None
    if level.below is not None:
        follows = not level.buf[level.end : stop if place is None else place].strip(b"\0")
        if not follows or (place is None and level.last):
            work += [(_search, level), (_take, level.below, b"", True)]
            level.below = None
            return
    if place is not None:
        level.at = level.start = level.fed = place
        level.stream, level.made = _opened(bytes(level.buf[place : place + _HEAD])), 0
        work += [(_search, level), (_feed, level, b"")]
        return
    yield from _told(level, stop)
    del level.buf[:stop]
    level.at, level.done, level.end = 0, 0, level.end - stop
    if level.last:
        yield from _told(level, 0)


def _feed(work, seen, level: _Data, data: bytes) -> Iterator[str]:
    """More data into the stream of a level, little at first; what comes out goes to the level below."""
    if not data:
        begin = level.fed
        level.fed = min(begin + max(4 * (begin - level.start), _HEAD << 6), len(level.buf))
        data = bytes(level.buf[begin : level.fed])
    broken, part, left = False, b"", None
    try:
        part, left = _step(level.stream, data)
    except _BROKEN:
        broken = True
    if part and not level.made:
        mark = hashlib.sha256(level.buf[level.start : level.start + _MARKED]).digest()
        if mark in level.marks or _repeated(level, part, seen):
            level.stream, level.at = None, level.start + 1
            return
        if level.below is None:
            level.below = _Data(level.marks | {mark})
    level.made += len(part)
    below = level.below
    if not broken and level.stream.eof:
        yield from _told(level, level.start)
        level.stream, level.at = None, level.fed - len(left)
        level.end = level.done = level.at
    elif not broken and (left is not None or level.fed < len(level.buf)):
        work.append((_feed, level, left or b""))
    elif broken or level.last:
        level.stream, level.at = None, level.start + 1
        if level.made:
            level.below = None
            work.append((_take, below, b"", True))
    if part:
        work.append((_take, below, part, False))


def _repeated(level: _Data, part: bytes, seen: set) -> bool:
    """Whether the same bytes, to the end of the data, were inflated before; most false streams are too short to ask."""
    if not level.last or level.below is not None or (len(part) < 256 and len(level.buf) - level.start > _MARKED):
        return False
    mark = hashlib.sha256(memoryview(level.buf)[level.start :]).digest()
    known = mark in seen
    seen.add(mark)
    return known


def _told(level: _Data, stop: int) -> Iterator[str]:
    """Bytes up to ``stop`` are text; it is given out by the piece, and runs of code characters go whole into the next one."""
    if level.text is None:
        return
    level.text += level.buf[level.done : stop]
    level.fresh += stop - level.done
    level.done = stop
    ends = level.last and stop == len(level.buf)
    if not ends and level.fresh < PIECE:
        return
    kept = len(level.text) if ends else len(level.text[: max(len(level.text) - OVERLAP, 0)].rstrip(_RUN))
    level.fresh = 0
    if kept:
        if _STRETCH.search(level.text):
            yield level.text.decode("utf-8", "replace")
        del level.text[:kept]


def _below(raw: bytes, low: int, high: int) -> Iterator[Layer]:
    """Layers of compressed bytes; all their characters stand for one span."""
    for text in _inflated(raw):
        yield Layer(text, np.broadcast_to(low, len(text)), np.broadcast_to(high, len(text)))


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """The layer with decodable runs replaced."""
    texts, first, last = [], array("q"), array("q")
    done, changed = 0, False
    for m in pattern.finditer(layer.text):
        a, b = m.span()
        found = decode(m[0])
        if found is None:
            continue
        changed = True
        texts += [layer.text[done:a], "".join(c for c, _, _ in found)]
        for places in (first, last):
            places.extend(range(done, a))
        first.extend(a + s for _, s, _ in found)
        last.extend(a + e - 1 for _, _, e in found)
        done = b
    if changed:
        texts.append(layer.text[done:])
        for places in (first, last):
            places.extend(range(done, len(layer.text)))
        first, last = np.frombuffer(first, np.int64), np.frombuffer(last, np.int64)
        text = "".join(texts)
        yield Layer(text, first, last + 1) if layer.low is None else Layer(text, layer.low[first], layer.high[last])


def _bytes_of(token: str, code: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that ASCII characters and codes stand for, and where each begins (with the end)."""
    chars = np.frombuffer(token.encode("ascii"), np.uint8)
    begin, size, value = array("q"), array("q"), bytearray()
    for m in code.finditer(token):
        begin.append(m.start())
        size.append(m.end() - m.start())
        value.append(int(m[1], 16) if m[1] else _SHORT.get(m[0], ord(m[0][-1])))
    begin, size = np.array(begin, np.int64), np.array(size, np.int64)
    depth = np.zeros(len(chars) + 1, np.int8)
    depth[begin + 1] = 1
    depth[begin + size] = -1
    starts = np.flatnonzero(np.cumsum(depth[:-1], dtype=np.int8) == 0)
    raw = chars[starts]
    raw[np.searchsorted(starts, begin)] = np.frombuffer(bytes(value), np.uint8)
    return raw, np.r_[starts, len(chars)]


def _coded(layer: Layer, token: re.Pattern, code: re.Pattern) -> Iterator[Layer]:
    """Layers below compressed bytes that are written as codes and literal characters."""
    for t in token.finditer(layer.text):
        if t.end() - t.start() < _STREAM_LEAST:
            continue
        if code.search(t[0]) is None and not _MAGIC.search(t[0].encode("ascii")):
            continue
        raw, places = _bytes_of(t[0], code)
        forms = [raw.tobytes()]
        if code is _URL_CODE and "+" in t[0]:  # a blank, in forms
            blank = raw.copy()
            blank[np.frombuffer(t[0].encode("ascii"), np.uint8)[places[:-1]] == ord("+")] = 32
            forms.append(blank.tobytes())
        for form in forms:
            for a, b in _streams(form):
                yield from _below(form[a:b], *layer.span(t.start() + int(places[a]), t.start() + int(places[b])))


def _chars(raw: bytes, width: int):
    """Characters of UTF-8 bytes with the place of each among codes of ``width`` characters a byte."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, at * width, (at + n) * width))
        at += n
    return out


def _url(run: str):
    raw = binascii.unhexlify(run.replace("%", ""))
    return _chars(raw, 3)


def _escape(run: str):
    if run[:2] == "\\x":
        raw = binascii.unhexlify(run.replace("\\x", ""))
        return _chars(raw, 4) or [(chr(b), 4 * i, 4 * i + 4) for i, b in enumerate(raw)]
    if run[:2] == "\\u" and run[2] != "{":
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        out, i = [], 0
        while i < len(units):
            u, n = units[i], 1
            if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                u, n = 0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00, 2
            out.append((chr(u) if not 0xD800 <= u < 0xE000 else "�", 6 * i, 6 * (i + n)))
            i += n
        return out
    digits = run.strip("&#;\\uU{}")
    code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits, 16 if run[0] == "\\" else 10)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(run))]


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Runs of base64 characters with the place of each, also over lines of equal width."""
    for m in _BASE64.finditer(text):
        yield m[0].rstrip("="), np.arange(m.start(), m.end())
    for m in _LINES.finditer(text):
        cuts = [x.span() for x in _BREAK.finditer(text, *m.span())]
        lines = list(zip([m.start(), *(b for _, b in cuts)], [*(a for a, _ in cuts), m.end()]))
        width = [b - a for a, b in lines]
        first = 0
        while first < len(lines):
            last = first + 1
            while last < len(lines) and width[last] == width[first]:
                last += 1
            # The last line may be shorter; the line before may begin with something else.
            stop = last + (last < len(lines) and width[last] < width[first])
            for begin in {first, max(first - 1, 0)}:
                if stop - begin > 1 and sum(width[begin:stop]) >= BASE64_LEAST:
                    places = [np.arange(a, b) for a, b in lines[begin:stop]]
                    yield "".join(text[a:b] for a, b in lines[begin:stop]), np.concatenate(places)
            first = last


def _base64(layer: Layer) -> Iterator[Layer]:
    """What runs hold at each of the four alignments: texts, readable stretches and compressed data."""
    low = (lambda k: k) if layer.low is None else layer.low.__getitem__
    high = (lambda k: k + 1) if layer.high is None else layer.high.__getitem__
    for chars, places in _runs(layer.text):
        chars = chars.replace("-", "+").replace("_", "/")
        for shift in range(4):
            run = chars[shift:]
            if len(run) % 4 == 1:
                run = run[:-1]
            raw = base64.b64decode(run + "=" * (-len(run) % 4))
            at = places[shift : shift + len(run)]
            for a, b in _streams(raw):
                here = places[shift + a * 8 // 6 :] if b == len(raw) else at[a * 8 // 6 : (b * 8 + 5) // 6]
                yield from _below(raw[a:b], int(low(here).min()), int(high(here).max()))
            if (text := _readable(raw)) is not None:
                found = [(0, text)]
            else:
                found = [(m.start(), m[0].decode()) for m in _STRETCH.finditer(raw)]
            for begin, text in found:
                ends = begin + np.cumsum([len(c.encode()) for c in text])
                starts = np.r_[begin, ends[:-1]]
                yield Layer(text, low(at[starts * 8 // 6]), high(at[np.minimum((ends * 8 + 5) // 6, len(run)) - 1]))


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and _URL.search(text):
        yield from _replaced(layer, _URL, _url)
        if _BINARY_URL.search(text):
            yield from _coded(layer, _URL_TOKEN, _URL_CODE)
    if ("\\" in text or "&#" in text) and _ESCAPE.search(text):
        yield from _replaced(layer, _ESCAPE, _escape)
        if "\\x" in text or "\\u00" in text:
            yield from _coded(layer, _ESCAPE_TOKEN, _ESCAPE_CODE)
    yield from _base64(layer)


def _ordered(spans: set[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(text: str) -> tuple[list[Span], list[Span], int]:
    """(base spans, all spans, layers scanned); spans are code points, end exclusive."""
    base = list(scan(text))
    found = set(base)
    work, seen = [iter([Layer(text)])], set()
    layers = 0
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if layers:
            place = (int(layer.low.min()), int(layer.high.max()))
            mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), place)
            if mark in seen:
                continue
            seen.add(mark)
            found.update((kind, *layer.span(a, b)) for kind, a, b in scan(layer.text))
        layers += 1
        work.append(x for x in _unwrapped(layer) if x.text)
    return _ordered(set(base)), _ordered(found), layers


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def _list(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, base, spans (arrays of kind, start, end), layers (scanned, the text included).

    Base findings are those of the patterns in the text itself; ``spans`` holds
    them and what turned up in decoded layers.  NULL text counts as empty; a text
    without a finding has empty arrays.  Repeated rows give repeated results, an
    empty table none.  Texts of any length are scanned whole, each in one task.  Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([_list(b) for b, _, _ in found], _SPANS),
                    pa.array([_list(s) for _, s, _ in found], _SPANS),
                    pa.array([n for _, _, n in found], pa.int32()),
                ],
                names=["id", "base", "spans", "layers"],
            )

    ident = rows.select("id").schema[0].dataType.simpleString()
    schema = f"id {ident}, base {_SPANS_DDL}, spans {_SPANS_DDL}, layers int"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def joined(spans: str | Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the kind of its first span."""
    out, done, at = [], 0, 0
    while at < len(spans):
        kind, a, b = spans[at]
        at += 1
        while at < len(spans) and spans[at][1] < b:
            b = max(b, spans[at][2])
            at += 1
        out += [text[done:a], f"[{kind}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with all findings taken out of the text; NULL stays NULL, other rows stay as they are.

    ``chars_col``: a column that holds the number of characters, renewed where the text changes.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            clean = [t if not t or not (s := find(t)[1]) else redacted(t, s) for t in texts]
            new = {text_col: clean}
            if chars_col is not None:
                sizes = batch.column(chars_col).to_pylist()
                new[chars_col] = [n if a == b else len(b) for a, b, n in zip(texts, clean, sizes)]
            for name, column in new.items():
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
