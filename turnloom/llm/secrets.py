r"""Secrets in texts and in what is encoded in them.

A worklist starts with the text and holds layers. Each layer is scanned for secrets and opened:

* percent escapes (%41) and Unicode escapes (\u0041, \U00000041, \u{41}, \x41) give the whole layer with them decoded,
  so that a secret may stand half outside them;
* each base64 run (either alphabet, 16 characters or more) gives a layer of what it holds; runs that lines break, as
  mail and `base64` write them, are also read as one;
* base64 or percent-escaped bytes that start like gzip, zlib, bzip2, xz or Zstandard are decompressed first: all
  members, and of a stream that breaks off as much as there is.

Bytes are read as UTF-8. NULs are left out, so plain letters in UTF-16 and UTF-32 are read too, and a byte that isn't
UTF-8 is one U+FFFD. A layer in which nowhere eight printable ASCII characters meet can hold neither a secret nor
another layer, and isn't kept.

Layers are opened until nothing new comes. A layer whose text has been seen at the same place isn't opened again,
so cycles end. Every character of a layer knows where in its parent it comes from, and so where in the original text; a
secret found in any layer is reported as a span of the original text: for compressed data, the whole run. Compressed data
come in layers of WINDOW bytes which overlap by OVERLAP, so no layer is held whole that is much larger than the
text; a secret or a run longer than OVERLAP may be cut there. Of what a text unpacks to beyond most_bytes in all (MOST_BYTES unless said
otherwise; None for no bound), nothing more is opened, and nothing that needs a dictionary or window beyond DECODER_BYTES is; n_unopened counts
both. Without an end, data that unpack to more compressed data would go on for ever.

An escape of an escape of an escape (%252525..41) is a layer for each; of more than NESTED in a row all but NESTED are undone in one step. Between
those nothing new can be found but ends of the same run of digits: the escape's first character ends every secret before it.

Positions are code points, ends exclusive. Documents are scanned one by one where they lie; nothing is shuffled. A layer
keeps its text and a few numbers for each escape in it, not for each character.

Defined results: null and empty texts have no spans. Rows stay as they are, repeated ones and null ids too; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import text_rows

# What counts as a secret, in this order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: as long as [0-9a-f]+ and no shorter ones
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

MOST_BYTES = 1 << 30
#: What a decoder may hold. It is taken as it is filled, so a stream that only declares much needs little.
DECODER_BYTES = 2 << 30
NESTED = 8
WINDOW, OVERLAP = 8 << 20, 64 << 10
_STEP, _FEED = 64 << 10, 16 << 10
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
)
_BACKSLASH = r"(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}|U0000005[cC])"
_PERCENTS = re.compile(r"%(?:25)+(?=(?:25){NESTED}[0-9A-Fa-f]{2})".replace("NESTED", str(NESTED)))
_BACKSLASHES = re.compile(rf"\\{_BACKSLASH}+(?={_BACKSLASH}{{{NESTED}}})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_PART = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_-]{16,}={0,2}")
_PLAIN = re.compile(r"[\x20-\x7e]{8}")
_URL_SAFE = str.maketrans("-_", "+/")

#: Where the characters [start, end) of a layer come from in its parent.
Source = Callable[[int, int], tuple[int, int]]


def _found(text: str) -> dict[str, Iterator[tuple[int, int, str]]]:
    """The matches of each kind, as they are asked for."""
    lower = text.lower()
    assign = ASSIGN.finditer(text) if any(k in lower for k in _KEYWORDS) else ()
    access = ACCESS.finditer(text) if "AKIA" in text else ()
    return {
        "assign": ((m.start(), m.end(), "assign") for m in assign if m.end(2) - m.start(2) >= LEAST_ASSIGN),
        "access": ((m.start(), m.end(), "access") for m in access if m.end() - m.start() >= LEAST_ACCESS),
        "hex": ((m.start(), m.end(), "hex") for m in HEX.finditer(text)),
    }


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind."""
    return sorted((s for found in _found(text).values() for s in found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def kinds_in(text: str) -> list[str]:
    return [kind for kind, found in _found(text).items() if next(found, None)]


def _opener(head: bytes):
    """A decompressor for data that start like this, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=DECODER_BYTES)
    return zstandard if head[:4] == b"\x28\xb5\x2f\xfd" else None


class TooLarge(Exception):
    """A stream needs a dictionary or window beyond DECODER_BYTES."""


def unpacked(data: bytes) -> Iterator[bytes]:
    """What compressed data hold, in steps: every member, and of one that breaks off what can be read. Nothing, if data aren't compressed.

    At a member that needs too large a decoder TooLarge is raised.
    """
    while (opener := _opener(data[:6])) is not None:
        left = b""
        try:
            if opener is zstandard:
                reader = zstandard.ZstdDecompressor(max_window_size=DECODER_BYTES).stream_reader(data, read_across_frames=True)
                while step := reader.read(_STEP):
                    yield step
            else:
                for at in range(0, len(data), _FEED):
                    part = data[at : at + _FEED]
                    yield from _fed(opener, part)
                    if opener.eof:
                        left = opener.unused_data + data[at + _FEED :]
                        break
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError) as error:
            if re.search("(?i)memory", str(error)):
                raise TooLarge from error
            return
        data = left.lstrip(b"\x00")


def _fed(opener, part: bytes) -> Iterator[bytes]:
    """What comes out when part goes in."""
    if hasattr(opener, "unconsumed_tail"):
        while part and not opener.eof:
            yield opener.decompress(part, _STEP)
            part = opener.unconsumed_tail
    else:
        yield opener.decompress(part, _STEP)
        while not opener.eof and not opener.needs_input:
            yield opener.decompress(b"", _STEP)


class Budget:
    """How many bytes a text may still unpack to, and how often it would have been more."""

    def __init__(self, most: int | None):
        self.left, self.refused = most, 0

    def windows(self, data: bytes) -> Iterator[bytes]:
        """Windows of what data unpack to."""
        held = bytearray()
        try:
            for step in unpacked(data):
                if self.left is not None:
                    if len(step) > self.left:
                        self.refused += 1
                        break
                    self.left -= len(step)
                held += step
                if len(held) >= WINDOW:
                    yield bytes(held)
                    del held[:-OVERLAP]
        except TooLarge:
            self.refused += 1
        if held:
            yield bytes(held)


def read_bytes(data: bytes) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    """data as text, and for each character the byte at which it starts and its last (None: characters are bytes)."""
    if data.isascii() and 0 not in data:
        return data.decode("ascii"), None, None
    kept = np.flatnonzero(np.frombuffer(data, np.uint8))
    raw = data.replace(b"\x00", b"").decode("utf-8", "surrogateescape")
    code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    upto = np.cumsum(size)
    return re.sub("[\udc80-\udcff]", "\ufffd", raw), kept[upto - size], kept[upto - 1]


class Layer:
    """A text, and where its characters come from in the parent's."""

    __slots__ = ("text", "parent", "source", "depth", "whole")

    def __init__(self, text: str, parent: Layer | None = None, source: Source | None = None, whole: bool = False):
        self.text, self.parent, self.source = text, parent, source
        self.depth = parent.depth + 1 if parent else 0
        self.whole = whole or parent is not None and parent.whole  # all of it comes from one span

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text. All sources rise, so the first and the last character tell."""
        layer = self
        while layer.parent is not None:
            start, end = layer.source(start, end)
            layer = layer.parent
        return start, end

    def secrets(self) -> Iterator[tuple[int, int, str]]:
        """The spans of the original text of the secrets in this layer; where all have one span, each kind once."""
        if self.whole:
            span = self.span(0, len(self.text))
            yield from ((*span, kind) for kind in kinds_in(self.text))
        else:
            yield from ((*self.span(start, end), kind) for start, end, kind in base_spans(self.text))


class Rewritten:
    """The source of a text in which matches were replaced by what they decode to."""

    def __init__(self):
        self.at, self.n, self.start, self.end = (array("q") for _ in range(4))
        self.bytes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, at: int, n: int, span: tuple[int, int], starts=None, lasts=None) -> None:
        if starts is not None:
            self.bytes[len(self.at)] = (starts, lasts)
        for column, x in zip((self.at, self.n, self.start, self.end), (at, n, *span)):
            column.append(x)

    def _one(self, i: int) -> tuple[int, int]:
        m = bisect_right(self.at, i) - 1
        if m < 0:
            return i, i + 1
        k = i - self.at[m]
        if k >= self.n[m]:
            return self.end[m] + k - self.n[m], self.end[m] + k - self.n[m] + 1
        if m in self.bytes:
            starts, lasts = self.bytes[m]
            return self.start[m] + 3 * int(starts[k]), self.start[m] + 3 * int(lasts[k]) + 3
        width = (self.end[m] - self.start[m]) // self.n[m]
        return self.start[m] + width * k, self.start[m] + width * (k + 1)

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        return self._one(start)[0], self._one(end - 1)[1]


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match replaced by decode(match): text, and its bytes' places or none; None leaves a match."""
    out, last, at, source = [], 0, 0, Rewritten()
    for m in pattern.finditer(layer.text):
        if (new := decode(m)) is None or not new[0]:
            continue
        out += [layer.text[last : m.start()], new[0]]
        at += m.start() - last
        source.add(at, len(new[0]), m.span(), *new[1:])
        at += len(new[0])
        last = m.end()
    if not out:
        return None
    return Layer("".join([*out, layer.text[last:]]), layer, source)


def _escaped_bytes(run: str) -> bytes:
    return bytes.fromhex(run.replace("%", ""))


def _percent(m: re.Match):
    return read_bytes(_escaped_bytes(m[0]))


def _unicode(m: re.Match):
    """The character; a pair of surrogates is one, a single one becomes U+FFFD."""
    if m[1]:
        return (chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00),)
    value = int(m[3] or m[4] or m[5] or m[6], 16)
    return ("\ufffd" if 0xD800 <= value < 0xE000 else chr(value),) if value < 0x110000 else None


class Base64Source:
    """The source of text read from base64: lines (place in the joined run, place in the text, length) and the bytes of characters."""

    def __init__(self, lines: list[tuple[int, int, int]], starts: np.ndarray | None, lasts: np.ndarray | None):
        self.first, self.place = [x[0] for x in lines], [x[1] for x in lines]
        self.total = lines[-1][0] + lines[-1][2]
        self.starts, self.lasts = starts, lasts

    def _at(self, i: int) -> int:
        line = bisect_right(self.first, i) - 1
        return self.place[line] + i - self.first[line]

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        a = start if self.starts is None else int(self.starts[start])
        b = end - 1 if self.lasts is None else int(self.lasts[end - 1])
        return self._at(a // 3 * 4), self._at(min(self.total, b // 3 * 4 + 4) - 1) + 1


def _decoded(run: str) -> bytes:
    """The bytes of base64 in either alphabet; a last character that completes no byte goes."""
    body = run.rstrip("=").translate(_URL_SAFE)
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _blocks(lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Broken runs among lines (place, length): lines of one length and the shorter one that ends them, with and without the line before.

    That one may be the rest of a line that starts with something else, or a word that isn't part of the run.
    """
    first = 0
    for i in range(1, len(lines) + 1):
        if i < len(lines) and lines[i][1] == lines[first][1]:
            continue
        end = i + (i < len(lines) and lines[i][1] < lines[first][1])
        if end - first > 1:
            yield lines[first:end]
        if first:
            yield lines[first - 1 : end]
        first = i


def _runs(text: str) -> Iterator[list[tuple[int, int, int]]]:
    """Base64 runs as lines (place in the joined run, place in the text, length): each by itself, and those that lines break."""
    for m in _BASE64.finditer(text):
        yield [(0, m.start(), len(m[0]))]
        if re.search("[-_]", m[0]):
            parts = [(0, m.start() + p.start(), len(p[0])) for p in _PART.finditer(m[0])]
            yield from ([p] for p in parts if p[2] < len(m[0]))
    for m in _LINES.finditer(text) if "\n" in text else ():
        for block in _blocks([(m.start() + x.start(), len(x[0])) for x in _LINE.finditer(m[0])]):
            at = np.cumsum([0, *(n for _, n in block)]).tolist()
            yield [(k, place, n) for k, (place, n) in zip(at, block)]


def opened(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The layers inside a layer."""
    text = layer.text

    def unpacked_layers(data: bytes, start: int, end: int) -> Iterator[Layer | None]:
        """A layer of each window; None if data aren't compressed."""
        windows = budget.windows(data) if _opener(data[:6]) is not None else iter(())
        if (window := next(windows, None)) is None:
            yield None
        while window is not None:
            inner = read_bytes(window)[0]
            if _PLAIN.search(inner):
                yield Layer(inner, layer, lambda a, b: (start, end), whole=True)
            window = next(windows, None)

    if "%" in text:
        less = _rewritten(layer, _PERCENTS, lambda m: ("%",))
        if (plain := less or _rewritten(layer, _PERCENT, _percent)) is not None:
            yield plain
        for m in _PERCENT.finditer(text):
            yield from filter(None, unpacked_layers(_escaped_bytes(m[0]), *m.span()))
    if "\\" in text:
        less = _rewritten(layer, _BACKSLASHES, lambda m: ("\\",))
        if (plain := less or _rewritten(layer, _UNICODE, _unicode)) is not None:
            yield plain
    for lines in _runs(text):
        data = _decoded("".join(text[place : place + n] for _, place, n in lines))
        for found in unpacked_layers(data, lines[0][1], lines[-1][1] + lines[-1][2]):
            if found is not None:
                yield found
                continue
            inner, starts, lasts = read_bytes(data)
            if _PLAIN.search(inner):
                yield Layer(inner, layer, Base64Source(lines, starts, lasts))


def secrets_in(text: str, most_bytes: int | None = -1) -> tuple[list[tuple[int, int, str, int]], int, int]:
    """All spans (start, end, kind, depth), the number of layers below the text, and how often what they unpack to was too much (-1: MOST_BYTES).

    Base spans have depth 0; a span found in several layers is listed once, with the depth at which it was first found.
    """
    root, budget = Layer(text), Budget(MOST_BYTES if most_bytes == -1 else most_bytes)
    spans: dict[tuple[int, int, str], int] = {}
    seen, n_layers = {(xxhash.xxh3_128_digest(text.encode()), 0, len(text))}, 0
    for start, end, kind in base_spans(text):
        spans[start, end, kind] = 0
    work = [opened(root, budget)]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        mark = (xxhash.xxh3_128_digest(layer.text.encode()), *layer.span(0, len(layer.text)))
        if mark in seen:
            continue
        seen.add(mark)
        n_layers += 1
        for span in layer.secrets():
            spans.setdefault(span, layer.depth)
        work.append(opened(layer, budget))
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return [(*s, spans[s]) for s in ordered], n_layers, budget.refused


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])


def find_secrets(docs: DataFrame, most_bytes: int | None = -1) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, spans (kind, start, end, depth), n_layers, n_unopened."""

    def _scan(batches):
        for batch in batches:
            spans, layers, unopened = [], [], []
            for text in text_rows(batch):
                found, n, u = secrets_in(text or "", most_bytes)
                spans.append([{"kind": k, "start": s, "end": e, "depth": d} for s, e, k, d in found])
                layers.append(n)
                unopened.append(u)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(layers, pa.int64()), pa.array(unopened, pa.int64())],
                ["doc_id", "spans", "n_layers", "n_unopened"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(
        _scan, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, depth: int>>, n_layers long, n_unopened long"
    )


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        "n_layers",
        "n_unopened",
    )
