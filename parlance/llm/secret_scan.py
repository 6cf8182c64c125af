"""Secrets in texts and in what texts encode.

URL, Unicode-escape, base64 and compressed layers are unwrapped until nothing new appears; each layer is scanned
again, and what it holds is reported at the place of its outermost code in the text. Escapes are decoded where
they stand, so that a secret may be escaped in part: its place then takes in the whole codes that it touches.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import urllib.parse
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
LAYERS = ("url", "unicode", "base64", "zip")
#: Kinds in their order: those of the text itself, then those found under layers, by the outermost layer.
KINDS = (*BASE, *(f"{layer}.{kind}" for layer in LAYERS for kind in BASE))
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
#: A compressed layer is inflated and scanned in pieces of about so many bytes.
CHUNK = 1 << 20
#: So many compressed streams are read from each other; the next one is read whole first.
STREAMS = 64

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_URL = re.compile(r"(?<![A-Za-z0-9_.~+/=:&?;,@-])[A-Za-z0-9_.~+/=:&?;,@-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~+/=:&?;,@-]*+)++")
_UNICODE = re.compile(r"(?:\\u[0-9a-fA-F]{4})++")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Escaped bytes of compressed data: a run of printable characters; where such data may start.
_URL_BYTES = re.compile(r"[!-~]+")
_URL_PACKED = re.compile(r"%1f%8b|(?:x|%78)(?:%01|%9c|%da|%5e|\^)", re.I)
_PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01^\x9c\xda]")
#: Decoded characters that may be bytes.
_BYTES = re.compile(r"[\x00-\xff]{3,}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Places that no secret and no code spans: behind a space between two plain words, or behind a line that ends, or before one that starts, with no letter of a code, or behind a control character or a letter beyond ASCII.
_CUT = re.compile(r"""(?<=[ \n][A-Za-z,;!?()])[ ](?=[A-Za-z,;!?()]+[ \n])|(?:(?<=[ \n])|^)[A-Za-z,;!?()]++[ ](?=[A-Za-z,;!?()]+[ \n])|[^A-Za-z0-9+/_\-\s][ \t]*\r?\n|\n(?=[ \t]*(?:[^A-Za-z0-9+/_\-\s]|\r?\n))|[^\t\n\r -~]""")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one layer."""
    out = []
    low = text.encode().lower()  # bytes: A-Z only
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78"


def _inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """All members of a compressed stream in chunks; a broken one as far as it goes."""
    stream, members = None, 0
    for data in chunks:
        while data:
            if stream is None:
                data = data.lstrip(b"\0") if members else data  # members may be padded
                if members and data[:1] != b"\x1f":
                    break
                stream = zlib.decompressobj(47)
            try:
                out = stream.decompress(data, CHUNK)
                data = stream.unconsumed_tail
                while out:
                    yield out
                    out = stream.decompress(data, CHUNK)
                    data = stream.unconsumed_tail
            except zlib.error:
                return
            if stream.eof:
                data, stream, members = stream.unused_data, None, members + 1


def _pieces(chunks: Iterable[bytes]) -> Iterator[str]:
    """The text of a stream of bytes, in pieces that no secret and no code spans. An unbroken run is one piece."""
    decoder, held, searched = codecs.getincrementaldecoder("utf-8")("replace"), "", 0
    for data in chunks:
        held += decoder.decode(data)
        if len(held) < CHUNK:
            continue
        last = None
        for start in (max(searched, len(held) - 4096), searched):
            for last in _CUT.finditer(held, start):
                pass
            if last is not None:
                break
        if last is not None:
            yield held[: last.end()]
            held, searched = held[last.end() :], 0
        else:
            searched = max(0, len(held) - 1024)
    yield held + decoder.decode(b"", True)


def content(chunks: Iterable[bytes]) -> tuple[bool, Iterator[str]]:
    """Whether a stream of bytes is compressed, and the pieces of its text, inflated as often as it is compressed."""
    chunks, above, zipped, streams = iter(chunks), set(), False, 0
    while True:
        head = b""
        for data in chunks:
            head += data
            if len(head) > 2:
                break
        chunks = chain([head], chunks)
        if not _compressed(head):
            return zipped, _pieces(chunks)
        tried = _Recorded(chunks)
        inner = _inflated(tried)
        first = next(inner, None)
        if first is None:  # it only looks compressed
            return zipped, _pieces(chain(tried.read, chunks))
        tried.read = None
        zipped = True
        digest = hashlib.md5(first).digest()
        if digest in above:  # it holds itself
            return True, iter(())
        above.add(digest)
        second = next(inner, None)
        streams = streams + 1 if second is not None else 0
        chunks = iter((first,)) if second is None else chain([first, second], inner)
        if streams == STREAMS:
            chunks, streams = iter((b"".join(chunks),)), 0


class _Recorded:
    """Chunks of a stream, those that were read kept until `read` is None."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.read = chunks, []

    def __iter__(self) -> Iterator[bytes]:
        for data in self.chunks:
            if self.read is not None:
                self.read.append(data)
            yield data


class Layer:
    """A text that layers were taken from, in segments that know where they stand in the document.

    A plain segment is the document's own text, character by character; any other one stands for the whole of a span. The
    mask tells by its bits at which levels a segment was decoded.
    """

    __slots__ = ("text", "starts", "roots", "plain", "masks", "level")

    def __init__(self, text: str, starts: list[int], roots: list[tuple[int, int]], plain: list[bool], masks: list[int], level: int = 0):
        self.text, self.starts, self.roots, self.plain, self.masks, self.level = text, starts, roots, plain, masks, level

    @classmethod
    def whole(cls, text: str) -> Layer:
        return cls(text, [0], [(0, len(text))], [True], [0])

    @classmethod
    def at(cls, text: str, span: tuple[int, int]) -> Layer:
        return cls(text, [0], [span], [False], [0])

    def _roots(self, i: int, start: int, j: int, end: int) -> tuple[int, int]:
        a = self.roots[i][0] + start - self.starts[i] if self.plain[i] else self.roots[i][0]
        return a, self.roots[j][0] + end - self.starts[j] if self.plain[j] else self.roots[j][1]

    def place(self, start: int, end: int) -> tuple[int, int] | None:
        """Where a range stands in the document, with the whole of each code it touches; None if codes of some level don't touch it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_left(self.starts, end) - 1
        if reduce(or_, self.masks[i : j + 1], 0) != (1 << self.level) - 1:
            return None
        return self._roots(i, start, j, end)

    def last_code(self, start: int, end: int) -> int:
        """The end of the last code of this level in a range."""
        i = bisect_left(self.starts, end) - 1
        return end if self.masks[i] >> (self.level - 1) else max(start + 1, self.starts[i])

    def decoded(self, code: re.Pattern, decode: Callable[[str], str]) -> Layer:
        """The next layer: all matches of an expression decoded where they stand."""
        text, out, starts, roots, plain, masks = self.text, [], [], [], [], []
        n, at, k, last, bit = 0, 0, 0, len(self.starts) - 1, 1 << self.level
        bounds = [*self.starts[1:], len(text)]
        for m in chain(code.finditer(text), (None,)):
            a, b = m.span() if m else (len(text), len(text))
            while at < a:  # what stands before the code, segment by segment
                to = min(a, bounds[k])
                if at < to:
                    starts.append(n)
                    roots.append(self._roots(k, at, k, to))
                    plain.append(self.plain[k])
                    masks.append(self.masks[k])
                    n += to - at
                    out.append(text[at:to])
                    at = to
                if at == bounds[k] and k < last:
                    k += 1
            if m:
                i, mask = k, self.masks[k]
                while bounds[k] < b:
                    k += 1
                    mask |= self.masks[k]
                piece = decode(m[0])
                if piece:
                    starts.append(n)
                    roots.append(self._roots(i, a, k, b))
                    plain.append(False)
                    masks.append(mask | bit)
                    n += len(piece)
                    out.append(piece)
                at = b
                if at == bounds[k] and k < last:
                    k += 1
        return Layer("".join(out), starts, roots, plain, masks, self.level + 1)


def _from_url(code: str) -> str:
    return urllib.parse.unquote_to_bytes(code).decode("utf-8", "replace")


def _from_unicode(code: str) -> str:
    return bytes.fromhex(code.replace("\\u", "")).decode("utf-16-be", "replace")


def _chain(layer: Layer, code: re.Pattern, escape: re.Pattern, mark: str, unit: int) -> int:
    """How many levels a layer's escapes can be unwrapped at once: while all of them are escaped marks of escaped marks, a level only makes them
    shorter, and the mark stands in no secret and in no other code."""
    least = 0
    for m in code.finditer(layer.text):
        for e in escape.finditer(m.string, *m.span()):
            more = _RUNS[mark].match(m.string, e.start() + 1)
            n = (more.end() - more.start()) // unit if more else 0
            if n < 2:
                return 1
            least = min(least or n, n)
    return max(1, least - 1)


_RUNS = {"%": re.compile("(?:25)+"), "\\": re.compile("(?:u005[cC])+")}
_ESCAPES = {"%": re.compile("%[0-9A-Fa-f]{2}"), "\\": re.compile(r"\\u[0-9a-fA-F]{4}")}


def unescaped(layer: Layer) -> Iterator[tuple[str, Layer]]:
    """(layer's name, next layer) of the escapes in a layer."""
    if "%" in layer.text and _URL.search(layer.text):
        n = _chain(layer, _URL, _ESCAPES["%"], "%", 2)
        yield "url", layer.decoded(_URL, _from_url) if n == 1 else layer.decoded(re.compile("%(?:25){{{}}}".format(n)), lambda _: "%")
    if "\\u" in layer.text and _UNICODE.search(layer.text):
        n = _chain(layer, _UNICODE, _ESCAPES["\\"], "\\", 5)
        yield "unicode", layer.decoded(_UNICODE, _from_unicode) if n == 1 else layer.decoded(re.compile(r"\\(?:u005[cC]){{{}}}".format(n)), lambda _: "\\")


def _unbase64(code: str) -> bytes:
    code = code[: len(code) - (len(code) % 4 == 1)]
    return base64.b64decode(code.replace("-", "+").replace("_", "/") + "=" * (-len(code) % 4))


def _joined(text: str, lines: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(first, last) of lines that may be one code: a first one of any length, ones of equal length, and a last one not longer."""
    size = [b - a for a, b in lines]
    i = 0
    while i + 1 < len(lines):
        j = i + 1
        while j + 1 < len(lines) and size[j] == size[i + 1]:
            j += 1
        if size[j] > size[i + 1]:
            j -= 1
        yield i, j
        i = max(i + 1, j - 1) if size[i] == size[i + 1] else i + 1


def _packed(raw: bytes) -> Iterator[int]:
    """Where compressed data may start: at a header with a first block that can be one."""
    for m in _PACKED.finditer(raw):
        at = m.start()
        if raw[at] == 0x1F:
            if len(raw) > at + 3 and raw[at + 3] < 0x20:
                yield at
        elif len(raw) > at + 6:
            block = raw[at + 2]
            kind = block >> 1 & 3
            if kind == 1 or kind == 2 and block >> 3 <= 29 or kind == 0 and raw[at + 3] ^ raw[at + 5] == raw[at + 4] ^ raw[at + 6] == 0xFF:
                yield at


def _from(raw: bytes, start: int) -> Iterator[bytes]:
    """raw from a place on, first little and then more of it: what isn't compressed is told at once."""
    size = 256
    while start < len(raw):
        yield raw[start : start + size]
        start, size = start + size, min(2 * size, CHUNK)


def codes(layer: Layer, escaped: bool) -> Iterator[tuple[str, int, int, bytes, int]]:
    """(name, start, end, bytes, place in the bytes) of what is encoded in a layer: base64, wrapped one by all of its lines too, and
    compressed data under escapes, from each place where it may start. escaped: the layer came from Unicode escapes."""
    text = layer.text
    for m in _BASE64.finditer(text):
        yield "base64", *m.span(), _unbase64(m[0].rstrip("=")), 0
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            if m.end() - m.start() > 16:
                lines = [r.span() for r in _RUN.finditer(text, *m.span())]
                for i, j in _joined(text, lines):
                    code = "".join(text[a:b] for a, b in lines[i : j + 1])
                    if len(code) >= 16:
                        yield "base64", lines[i][0], m.end() if j + 1 == len(lines) else lines[j][1], _unbase64(code), 0
    if "%" in text and _URL_PACKED.search(text):
        for m in _URL_BYTES.finditer(text):
            if _URL_PACKED.search(m[0]):
                raw = urllib.parse.unquote_to_bytes(m[0])
                for start in _packed(raw):
                    yield "url", *m.span(), raw, start
    if escaped:
        for m in _BYTES.finditer(text):
            raw = m[0].encode("latin-1")
            for start in _packed(raw):
                yield "unicode", m.start() + start, layer.last_code(m.start() + start, m.end()), raw, start


class _Task(NamedTuple):
    outer: str  # the outermost layer, empty for the text itself
    layer: Layer
    seen: set  # digests of what was searched at this place
    escaped: bool


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; in code points of the text, end exclusive.

    Layers are a stack of work: a layer is scanned, what it holds is put on top of it, and each layer is searched once at each
    place, so that cycles end. No layer holds the ones above it, and no depth is too much.
    """
    found = set(scan(text))
    held: dict[tuple, set] = {}

    def inside(task: _Task) -> Iterator[_Task]:
        """What the codes of a layer hold, piece by piece."""
        for name, a, b, raw, start in codes(task.layer, task.escaped):
            if at := task.layer.place(a, b):
                zipped, pieces = content(_from(raw, start))
                if zipped or name == "base64":
                    outer = task.outer or ("zip" if zipped and name == "base64" else name)
                    own = held.setdefault((task.outer, at), set())
                    for piece in pieces:
                        yield _Task(outer, Layer.at(piece, at), own, False)

    work: list[Iterator[_Task]] = [iter((_Task("", Layer.whole(text), set(), False),))]
    while work:
        task = next(work[-1], None)
        if task is None:
            work.pop()
            continue
        digest = hashlib.md5(task.layer.text.encode("utf-8", "surrogatepass")).digest()
        if digest in task.seen:
            continue
        task.seen.add(digest)
        if task.outer:
            found.update((f"{task.outer}.{kind}", *at) for kind, a, b in scan(task.layer.text) if (at := task.layer.place(a, b)))
        work += [iter((_Task(task.outer or name, layer, task.seen if task.outer else set(), name == "unicode"),)) for name, layer in reversed([*unescaped(task.layer)])]
        work.append(inside(task))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


@F.arrow_udf(SPANS)
def _secrets(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "")] for t in texts], _SPANS)


def secrets(text: Column) -> Column:
    """Spans of secrets in a text, by start, then kind in the order of KINDS.

    A secret under layers has the kind "layer.kind" of its outermost layer and that layer's span. A null or
    empty text has none; the same secret twice is reported twice; a text of any length is scanned whole, in linear time.
    """
    return _secrets(text)
