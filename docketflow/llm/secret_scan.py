"""Secrets in whole texts and in what the texts wrap: URL escapes, Unicode escapes, base64 and compressed data.

Each text starts a worklist of layers. A layer is scanned with the base patterns, then unwrapped: all its URL escapes
decoded, all its Unicode escapes decoded, each base64 run decoded, compressed data decompressed. New layers join the list
until nothing new comes up; a layer that was seen at the same place isn't taken again, so cycles end. Every character of a
layer knows which code points of the text it came from, so findings are reported as spans of the text.

Base64 may be wrapped over lines and may touch other letters of its alphabet: a run that isn't text or compressed data as a
whole is decoded from each of the four alignments, and texts and compressed data are looked for in what comes out. Compressed
data is read to the end of its last member, in windows that overlap.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from docketflow.llm import batches

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
#: The shortest finding, ``token=`` and 8 characters, is 19 characters of base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
#: Base64 over several lines of any width.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
SPACE = re.compile(r"\s+")
#: Escapes of an escape's own first character, many levels deep: each level takes off only a few characters, so levels are taken off together.
NESTED = [(re.compile(r"%(?:25){4,}(?=[0-9A-Fa-f]{2})"), "%"), (re.compile(r"\\(?:x5[cC]){4,}(?=x[0-9A-Fa-f]{2})"), "\\"),
          (re.compile(r"\\(?:u005[cC]){4,}(?=u[0-9A-Fa-f]{4})"), "\\"), (re.compile(r"&(?:#38;|#[xX]26;|amp;){4,}(?=#)"), "&")]
#: Where a run may really begin: after a line break or one of the alphabet's marks.
BEGINS = re.compile(r"(?:\s+|[+/_-])(?=[^\s+/_-])")
#: Texts in decoded bytes; the shortest finding has 14 bytes.
READABLE = re.compile(rb"(?:[\t-\r\x1c-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}")
#: Beginnings of gzip, zstd, bzip2 and zlib data inside other bytes.
COMPRESSED = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|BZh[1-9]1AY&SY|\x78[\x01\x5e\x9c\xda]")
#: Characters that URL encoders leave as they are, with escapes among them.
URL_STRETCH = re.compile(r"(?<![\w.~/+!*'()%-])[\w.~/+!*'()-]*%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[\w.~/+!*'()-])*", re.ASCII)
URL_UNIT = re.compile(r"%[0-9A-Fa-f]{2}|.")
#: Texts without any of these have neither findings nor layers.
WORTH = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#|[A-Za-z0-9+/_-]{19}|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]"
#: Decompressed data is read in pieces and scanned in windows, each beginning with the last bytes of the one before.
PIECE_BYTES, WINDOW_BYTES, OVERLAP_BYTES = 1 << 20, 16 << 20, 1 << 20

SECRET = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()), T.StructField("layers", T.StringType())]))


def findings(text: str) -> Iterator[tuple[int, int, int]]:
    """Kind, start and end of the base patterns' matches."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            yield 0, m.start(), m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            yield 1, m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end()


class Layer:
    """Unwrapped text, the way to it, and the span of the original text that each character came from.

    ``starts`` and ``ends`` are one entry per character, or one for all characters.
    """

    def __init__(self, text: str, path: tuple[str, ...], starts: np.ndarray, ends: np.ndarray):
        self.text, self.path, self.starts, self.ends = text, path, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        if len(self.starts) == 1:
            return int(self.starts[0]), int(self.ends[0])
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def within(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.span(a, b)
        return np.array([start]), np.array([end])


def _unicode_run(run: str) -> str:
    """Escapes to characters; surrogate pairs join, lone surrogates and too large numbers become U+FFFD."""
    units = bytearray()
    for m in ONE_UNICODE.finditer(run):
        braced, short, long, byte, number, hexed = m.groups()
        code = int(number) if number else int(braced or short or long or byte or hexed, 16)
        units += code.to_bytes(2, "little") if code < 0x10000 else (chr(code) if code < 0x110000 else "\ufffd").encode("utf-16-le")
    return units.decode("utf-16-le", errors="replace")


def _replaced(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with all runs of ``pattern`` decoded; a decoded run's characters all map to the run."""
    out, starts, ends, last = [], [], [], 0
    one = len(layer.starts) == 1
    for m in pattern.finditer(layer.text):
        value = decode(m[0])
        out += [layer.text[last : m.start()], value]
        if not one:
            a, b = layer.span(m.start(), m.end())
            starts += [layer.starts[last : m.start()], np.full(len(value), a)]
            ends += [layer.ends[last : m.start()], np.full(len(value), b)]
        last = m.end()
    if not out:
        return None
    text = "".join(out) + layer.text[last:]
    if one:
        return Layer(text, (*layer.path, name), layer.starts, layer.ends)
    return Layer(text, (*layer.path, name), np.concatenate([*starts, layer.starts[last:]]), np.concatenate([*ends, layer.ends[last:]]))


def _flattened(layer: Layer) -> Layer | None:
    """The layer with escapes of escapes, from four levels on, as one level; None if it has none."""
    for pattern, mark in NESTED:
        if pattern.search(layer.text):
            flat = _replaced(layer, pattern, lambda _, mark=mark: mark, "nested")
            return _flattened(flat) or flat
    return None


def _url_run(run: str) -> str:
    raw = unquote_to_bytes(run)
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def compression(head: bytes) -> str | None:
    """What data that begins so is compressed with."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return "zlib"
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    return "bzip2" if head[:3] == b"BZh" else None


class _Source:
    """Chunks as a file, for zstd."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.left = chunks, b""

    def read(self, size: int = -1) -> bytes:
        if not self.left:
            self.left = next(self.chunks, b"")
        size = len(self.left) if size < 0 else size
        out, self.left = self.left[:size], self.left[size:]
        return out


def _pieces(name: str, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Content of all members of compressed data, up to its end or to where it is broken."""
    try:
        if name == "zstd":
            with zstandard.ZstdDecompressor().stream_reader(_Source(chunks), read_across_frames=True) as reader:
                while out := reader.read(PIECE_BYTES):
                    yield out
            return
        new = bz2.BZ2Decompressor if name == "bzip2" else lambda: zlib.decompressobj(31 if name == "gzip" else 15)
        member = new()
        for data in chunks:
            while data:
                out = member.decompress(data, PIECE_BYTES)
                if out:
                    yield out
                if member.eof:
                    data, member = member.unused_data, new()
                    if name == "gzip":
                        data = data.lstrip(b"\0")  # padding between members
                elif name != "bzip2":
                    data = member.unconsumed_tail
                else:
                    while not member.needs_input and not member.eof:
                        if out := member.decompress(b"", PIECE_BYTES):
                            yield out
                    data, member = (member.unused_data, new()) if member.eof else (b"", member)
            if name != "bzip2":
                while not member.eof and (out := member.decompress(b"", PIECE_BYTES)):
                    yield out
    except (zlib.error, zstandard.ZstdError, OSError, EOFError, ValueError):
        return


def _plain(raw: bytes) -> str | None:
    """Text of bytes that are text: UTF-8 without control characters other than white space."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if re.search(r"[\x00-\x08\x0e-\x1b\x7f]", text) else text


def _opened(raw: bytes, path: tuple[str, ...], starts: np.ndarray, ends: np.ndarray) -> Iterator[Layer]:
    """Layers from bytes: compressed data until none is left, in windows, or else the text that they are as a whole."""
    head, chunks, packed, unpacked = raw, iter([raw]), False, {hashlib.blake2b(raw[:PIECE_BYTES]).digest()}
    while (name := compression(head)) is not None:
        unread, chunks = itertools.tee(chunks)
        inner = _pieces(name, chunks)
        first = next(inner, None)
        if first is None:
            chunks = unread
            break
        del unread
        more = next(inner, None)
        # content of one piece needs its layers no longer; there may be thousands
        head, chunks, packed, path = first, iter([first]) if more is None else itertools.chain([first, more], inner), True, (*path, name)
        digest = hashlib.blake2b(first).digest()
        if digest in unpacked:  # data that unpacks to itself, or to what it came from
            return
        unpacked.add(digest)
    if not packed:
        text = _plain(raw)
        if text is not None:
            yield Layer(text, path, starts, ends)
        return
    held, size, fresh = [], 0, False
    for chunk in chunks:
        held.append(chunk)
        size, fresh = size + len(chunk), True
        if size >= WINDOW_BYTES:
            window = b"".join(held)
            yield Layer(window.decode(errors="replace"), path, starts, ends)
            held, size, fresh = [window[-OVERLAP_BYTES:]], OVERLAP_BYTES, False
    if fresh:
        yield Layer(b"".join(held).decode(errors="replace"), path, starts, ends)


def _decoded(run: str) -> bytes:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        run = run[:-1]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except binascii.Error:
        return b""


def _parts(layer: Layer, m: re.Match) -> Iterator[Layer]:
    """Texts and compressed data inside a base64 run, from each alignment; the run may be wrapped."""
    places = np.array([m.start() + i for i, c in enumerate(m[0]) if c in _ALPHABET])
    run, path = SPACE.sub("", m[0]).rstrip("="), (*layer.path, "base64")
    begins = {0, *np.searchsorted(places, [b.end() + m.start() for b in BEGINS.finditer(m[0])]).tolist()}
    for offset in range(4):
        raw = _decoded(run[offset:])
        for found in READABLE.finditer(raw):
            a, b = offset + found.start() * 4 // 3, min(len(run), offset + -(-found.end() * 4 // 3))
            stop = m.end() if b == len(run) or found.end() == len(raw) else int(places[b - 1]) + 1
            text = found[0].decode(errors="replace")
            starts, ends = layer.within(int(places[a]), stop)
            # what stands before a likely beginning may have become letters by chance: the rest doesn't span it
            later = next((k for k in range(a, min(a + 12, b)) if k in begins and (k - offset) % 4 == 0), a)
            if later > a:
                before = len(raw[found.start() : (later - offset) // 4 * 3].decode(errors="replace"))
                start = layer.within(int(places[later]), stop)[0]
                starts = np.where(np.arange(len(text)) < before, starts, start)
                ends = np.full(len(text), ends[0])
            yield Layer(text, path, starts, ends)
        for found in COMPRESSED.finditer(raw):
            a = offset + found.start() * 4 // 3
            if compression(raw[found.start() :]) is not None:
                yield from (x for x in _opened(raw[found.start() :], path, *layer.within(int(places[a]), m.end())) if len(x.path) > len(path))


_ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside a layer."""
    flat = _flattened(layer)
    if flat is not None:  # the levels in between differ in their number of escapes only
        yield flat
        return
    for pattern, decode, name in ((URL, _url_run, "url"), (UNICODE, _unicode_run, "unicode")):
        found = _replaced(layer, pattern, decode, name)
        if found is not None:
            yield found
            for m in pattern.finditer(layer.text):  # compressed bytes behind escapes
                raw = decode(m[0])
                if raw[:1] in "\x1f\x78\x28B" and max(map(ord, raw), default=256) < 256 and compression(raw.encode("latin-1")) is not None:
                    path = (*layer.path, name)
                    yield from (x for x in _opened(raw.encode("latin-1"), path, *layer.within(m.start(), m.end())) if len(x.path) > len(path))
    for m in URL_STRETCH.finditer(layer.text):  # compressed bytes of which only some are escaped
        path = (*layer.path, "url")
        for stretch in {m[0], m[0].replace("+", " ")}:
            raw = unquote_to_bytes(stretch)
            for found in COMPRESSED.finditer(raw):
                if compression(raw[found.start() :]) is not None:
                    a = next(itertools.islice(URL_UNIT.finditer(m[0]), found.start(), None)).start() + m.start()
                    yield from (x for x in _opened(raw[found.start() :], path, *layer.within(a, m.end())) if len(x.path) > len(path))
    for m in BASE64.finditer(layer.text):
        found = None
        for found in _opened(_decoded(m[0]), (*layer.path, "base64"), *layer.within(m.start(), m.end())):
            yield found
        if found is None:
            yield from _parts(layer, m)
    for m in WRAPPED.finditer(layer.text):
        run, found = SPACE.sub("", m[0]), None
        if len(run) < 19:
            continue
        for found in _opened(_decoded(run), (*layer.path, "base64"), *layer.within(m.start(), m.end())):
            yield found
        if found is None:
            yield from _parts(layer, m)


def scan_text(text: str) -> list[tuple[int, int, int, bool, str]]:
    """All findings of a text and its layers: kind, start, end, whether a base match of the text itself, way to the layer.

    What a line of wrapped base64 holds by itself is reported for the line, not for all lines again.
    """
    places = np.arange(len(text))
    work, seen = [iter([Layer(text, (), places, places + 1)])], set()
    found: dict[tuple[int, int, int], tuple[str, ...]] = {}
    values: dict[tuple[int, tuple[str, ...]], dict[tuple[int, int], str]] = {}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = (hashlib.blake2b(layer.text.encode(errors="surrogatepass")).digest(), int(layer.starts[0]), int(layer.ends[-1]))
        if key in seen:
            continue
        seen.add(key)
        for kind, a, b in findings(layer.text):
            span = layer.span(a, b)
            if (kind, *span) not in found or len(layer.path) < len(found[(kind, *span)]):
                found[(kind, *span)] = layer.path
            if layer.path:
                values.setdefault((kind, layer.path), {}).setdefault(span, layer.text[a:b])
        work.append(unwrapped(layer))
    for (kind, path), spans in values.items():
        reach: list[tuple[int, int]] = []
        for start, end in sorted(spans, key=lambda x: (x[1] - x[0], x)):
            value = spans[start, end]
            if any(start <= x and y <= end and spans[x, y] in value for x, y in reach):
                if found.get((kind, start, end)) == path:
                    del found[kind, start, end]
            else:
                reach.append((start, end))
    return [(k, a, b, not found[k, a, b], ">".join(found[k, a, b])) for k, a, b in sorted(found, key=lambda x: (x[1], x[0], x[2]))]


def redacted(text: str, spans: list[tuple[int, int, int, bool, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, last = [], 0
    for _, a, b, *_ in spans:
        if a >= last:
            out += [text[last:a], "[SECRET]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def scan(docs: DataFrame, text: str = "text", secrets: str = "secrets", redact: bool = False) -> DataFrame:
    """``docs`` with ``secrets``: findings by start, kind and end, in code points of the text, ends exclusive.

    With ``redact`` the text's spans are replaced by a mark and a null text stays null. Null and empty texts have no
    findings. Rows and other columns stay; ``secrets`` must be a new name.
    """
    if secrets.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {secrets}")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("layers", pa.string())]))
        for batch in batches.bounded(rows, text):
            column = batch.column(text)
            worth = pc.fill_null(pc.match_substring_regex(column, WORTH), False).to_numpy(zero_copy_only=False)
            found = [[] for _ in range(batch.num_rows)]
            new = {}
            for i in np.flatnonzero(worth).tolist():
                value = column[i].as_py()
                spans = scan_text(value)
                found[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": base, "layers": way} for k, a, b, base, way in spans]
                if redact and spans:
                    new[i] = redacted(value, spans)
            columns = list(batch.columns)
            if new:
                values = column.to_pylist()
                for i, value in new.items():
                    values[i] = value
                columns[batch.schema.get_field_index(text)] = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*batch.schema.names, secrets])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(secrets, SECRET)]))


def digest(found: DataFrame, key: str = "doc_id", secrets: str = "secrets") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` of scanned rows."""
    def joined(items):
        return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(secrets, lambda s: s["base"])
    return found.select(
        key, *[number(kind) for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(secrets)).alias("spans"))
