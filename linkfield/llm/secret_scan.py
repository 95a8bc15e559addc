"""Secrets in texts and in what the texts encode.

A text is the first layer of a worklist.  Whatever a decoder changes in a layer gives another one, with a map back to
the layer it came from, until nothing new comes; a layer that was seen before isn't taken again, so texts that decode to
one another end.  Every layer is scanned, and what it shows gets the place in the text that it was decoded from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

# Kinds in the order in which they are listed, their patterns, least lengths of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs of 18 and more
HEX = re.compile(r"[0-9a-f]{16,}")

NAMES = ("passw", "secret", "token", "apikey", "api_key")

#: What a compressed layer may unpack to, in bytes, and what all layers of a text may have together, in code points and
#: besides four times the text; what would go beyond is counted and stays packed.
UNPACKED, ALL_LAYERS = 1 << 24, 1 << 26

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8})+|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);")
ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
_B = r"[A-Za-z0-9+/_-]"
BASE64 = re.compile(rf"(?<!{_B})(?:(?:{_B}{{76}}\r?\n)+|(?:{_B}{{64}}\r?\n)+)?{_B}{{16,}}={{0,2}}")
PIECE = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
UNREADABLE = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f\ufffd]")


def found(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of a layer, leftmost and without overlap for each kind."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    return sorted(out)


@dataclass
class Layer:
    """A text and the pieces it was put together from: where each begins here, where it began and ended in the layer
    below, and whether it is a copy."""

    text: str
    below: Layer | None = None
    at: tuple[int, ...] = ()
    pieces: tuple[tuple[int, int, bool], ...] = ()

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The place in the first layer that start to end come from."""
        layer = self
        while layer.below is not None:
            first, last = bisect_right(layer.at, start) - 1, bisect_right(layer.at, end - 1) - 1
            (a, _, copied), (b, b_end, last_copied) = layer.pieces[first], layer.pieces[last]
            start, end = a + (start - layer.at[first] if copied else 0), b + end - layer.at[last] if last_copied else b_end
            layer = layer.below
        return start, end


def replaced(layer: Layer, parts: list[tuple[int, int, str]]) -> Layer:
    """layer with other texts in the places of some parts."""
    texts, at, pieces, here, done = [], [], [], 0, 0
    for start, end, text in [*parts, (len(layer.text), len(layer.text), "")]:
        for piece, copied, a, b in ((layer.text[done:start], True, done, start), (text, False, start, end)):
            if piece:
                texts.append(piece)
                at.append(here)
                pieces.append((a, b, copied))
                here += len(piece)
        done = end
    return Layer("".join(texts), layer, tuple(at), tuple(pieces))


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if UNREADABLE.search(text) else text


class Unpacked:
    """Bytes out of nested compressed layers; too_large counts those that are left packed."""

    def __init__(self):
        self.too_large = 0

    def _once(self, raw: bytes) -> bytes | None:
        try:
            if raw[:2] == b"\x1f\x8b":
                return self._bounded(zlib.decompressobj(31), raw)
            if raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
                return self._bounded(zlib.decompressobj(), raw)
            if raw[:3] == b"BZh":
                return self._bounded(bz2.BZ2Decompressor(), raw)
            if raw[:6] == b"\xfd7zXZ\x00":
                return self._bounded(lzma.LZMADecompressor(memlimit=1 << 27), raw)
            if raw[:4] == b"\x28\xb5\x2f\xfd":
                with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(raw) as reader:
                    out = reader.read(UNPACKED + 1)
                self.too_large += len(out) > UNPACKED
                return out if len(out) <= UNPACKED else None
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            pass
        return None

    def _bounded(self, engine, raw: bytes) -> bytes | None:
        out = engine.decompress(raw, UNPACKED + 1)
        self.too_large += len(out) > UNPACKED
        return out if len(out) <= UNPACKED and engine.eof else None

    def text(self, raw: bytes) -> str | None:
        seen = set()
        while (inner := self._once(raw)) is not None:
            digest = hashlib.sha256(inner).digest()
            if digest in seen:
                return None
            seen.add(digest)
            raw = inner
        return _readable(raw)


def url_decoded(layer: Layer, _: Unpacked) -> list[tuple[int, int, str]]:
    out = []
    if "%" in layer.text:
        for m in URL.finditer(layer.text):
            raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
            whole = _readable(raw)
            if whole is not None and len(whole) == len(raw):  # one character an escape: each keeps its own place
                out += [(at + 3 * i, at + 3 * i + 3, c) for i, c in enumerate(whole)]
            elif whole is not None:
                out.append((at, m.end(), whole))
            else:
                out += [(at + 3 * i, at + 3 * i + 3, chr(c)) for i, c in enumerate(raw) if 32 <= c < 127]
    return out


def unescaped(layer: Layer, _: Unpacked) -> list[tuple[int, int, str]]:
    out = []
    if "\\" in layer.text or "&" in layer.text:
        for m in ESCAPES.finditer(layer.text):
            if m[0][0] == "&":
                text = unescape(m[0])
                if text != m[0] and not UNREADABLE.search(text):
                    out.append((m.start(), m.end(), text))
                continue
            codes = [(e.start(), e.end(), int(e[1] or e[2] or e[3] or e[4], 16)) for e in ESCAPE.finditer(m[0])]
            at = 0
            while at < len(codes):
                start, end, code = codes[at]
                if 0xD800 <= code < 0xDC00 and at + 1 < len(codes) and 0xDC00 <= codes[at + 1][2] < 0xE000:  # two halves of one character
                    code, end, at = 0x10000 + ((code - 0xD800) << 10) + (codes[at + 1][2] - 0xDC00), codes[at + 1][1], at + 1
                at += 1
                if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 and not UNREADABLE.match(chr(code)):
                    out.append((m.start() + start, m.start() + end, chr(code)))
    return out


def _of_base64(run: str, unpacked: Unpacked) -> str | None:
    body = re.sub(r"[\r\n=]", "", run).replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return unpacked.text(base64.b64decode(body + "=" * (-len(body) % 4), validate=True))
    except binascii.Error:
        return None


def base64_decoded(layer: Layer, unpacked: Unpacked) -> list[tuple[int, int, str]]:
    """Runs that decode to readable text, or to something packed that holds some; where a run as a whole doesn't, pieces
    of it between signs (as of a path or a name in front of it)."""
    out = []
    for m in BASE64.finditer(layer.text):
        text = _of_base64(m[0], unpacked)
        if text is not None:
            out.append((m.start(), m.end(), text))
        elif re.search(r"[+/_-]", m[0]):
            for p in PIECE.finditer(m[0]):
                if len(p[0]) < len(m[0]) and (text := _of_base64(p[0], unpacked)) is not None:
                    out.append((m.start() + p.start(), m.start() + p.end(), text))
    return out


DECODERS = (url_decoded, unescaped, base64_decoded)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Spans of the text itself, spans of all layers (places in the text), number of layers, number of those left packed."""
    base = found(text)
    spans, unpacked, seen, work, layers, total = set(base), Unpacked(), {text}, [Layer(text)], 1, 0
    limit = ALL_LAYERS + 4 * len(text)
    while work:
        layer = work.pop()
        for decoder in DECODERS:
            parts = decoder(layer, unpacked)
            if not parts:
                continue
            above = replaced(layer, parts)
            if above.text in seen:
                continue
            if total + len(above.text) > limit:
                unpacked.too_large += 1
                continue
            seen.add(above.text)
            total, layers = total + len(above.text), layers + 1
            for start, kind, end in found(above.text):
                a, b = above.source(start, end)
                spans.add((a, kind, b))
            work.append(above)
    return base, sorted(spans), layers, unpacked.too_large


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_unopened long"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
    for batch in batches:
        out = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base, spans, layers, too_large = scan(text or "")
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            out.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers, too_large))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_assign, n_access, n_hex and base_sha256 of what stands in the text as it is,
    spans (kind:start:end in code points, end exclusive, by start, then kind, then end) of what it holds in any
    layer, n_layers, n_unopened.

    Layers come from URL escapes, Unicode escapes and numbered or basic character references, base64 (both alphabets,
    lines of 64 or 76 too) of readable UTF-8 or of gzip, zlib, bzip2, xz or zstandard data, and what lies in these, to any
    depth.  Each decoder changes all that it can in a layer at once, and texts around stay, so a name before an encoded
    value counts.  What is found in a decoded part has the place of the whole part (of single escapes, where these are
    single characters); spans that are found in several layers are listed once.

    Null text is an empty one: no spans, one layer.  Repeated rows and ids, null ids as well, each have their row; an
    empty table has none.  Packed data of over 16 MiB unpacked, and layers beyond 64 million code points and four times
    the text, aren't opened and counted in n_unopened.  Other columns go.
    """
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_scanned, RESULT)
