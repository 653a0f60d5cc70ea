"""Operator 2: secret scan with a recursive decoding worklist.

Each whole text is scanned for three kinds of secret, then every encoded segment of it is decoded
into a layer of its own, which is scanned and searched for further segments in turn, until nothing
new comes up. Escapes that are decoded keep, for each character, the span of the original text it
came from. All that comes out of a base64 segment has the place of that segment, so what a segment
holds is found once and reported at every place where it stands; cycles are found among the layers
of one segment.

Layers: percent escapes, backslash (octal ones as well) and HTML character escapes (by number or name),
base64 (standard and URL alphabet, also wrapped over lines or glued to a word before it), UTF-16 and gzip or zlib data inside base64.

Bytes that are not UTF-8 and control characters hide nothing: the layer is read around them.

Defined results: a null text is empty and has no spans; a repeated row is scanned again and gives
the same row; a compressed layer that inflates beyond ``most_inflated`` bytes (a decompression bomb)
is read in overlapping pieces and counted in ``n_oversized``, as a base64 run longer than half a
piece or compressed data inside such a layer that is longer than a piece may be read in part only;
texts have no length limit.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import carried, column, schema_with, slices

KINDS = ("assign", "access", "hex")
MOST_INFLATED = 64 << 20
RESULT = "spans array<struct<kind: string, start: int, end: int, depth: int>>, n_layers int, n_oversized int"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,30};")
#: An escape whose own sign is escaped again and again. What lies between differs in the number of times alone.
CHAIN = re.compile(r"%(?:25){9,}|&(?:#38;|#x26;|amp;){9,}|\\(?:u005c|x5c){9,}", re.IGNORECASE)
CHAIN_UNIT = re.compile(r"25|#38;|#x26;|amp;|u005c|x5c", re.IGNORECASE)
KEPT_UNITS = 8
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, all of them long but the last.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,}\r?\n)+[A-Za-z0-9+/]+={0,2}")
BASE64_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
GZIP = b"\x1f\x8b"
#: How gzip and zlib data may begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
OVERLAP = 1 << 16
#: What text that was worth encoding looks like: no control characters but white space. Other layers are read, too, but count only with a secret.
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f�]")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base spans: leftmost and non-overlapping within a kind. A match too short still uses up its text."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def compressed(data: bytes) -> bool:
    return data[:2] == GZIP or len(data) > 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0


def inflate(data: bytes, most: int) -> Iterator[bytes]:
    """Contents of gzip or zlib data, all members of it, in parts of at most ``most`` bytes; what follows comes as it is."""
    while compressed(data):
        unpack = zlib.decompressobj(47)
        try:
            while not unpack.eof:
                out = unpack.decompress(data, most)
                data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if out:
                    yield out
                elif not data:
                    break
        except zlib.error:
            return
        if not unpack.eof:
            return
        data = data.lstrip(b"\0")
    if data:
        yield data


def overlapping(parts: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Long data in pieces that overlap. A run of base64 at the end of a piece starts the next one, too.

    A run longer than half a piece is cut where a group of four ends, so that its rest decodes as well.
    """
    held, carried_over = b"", 0
    for part in parts:
        held += part
        if len(held) < carried_over + most:
            continue
        yield held
        run = len(held) - len(held.rstrip(BASE64_BYTES))
        carried_over = min(len(held), run + OVERLAP if run <= most // 2 else OVERLAP + (run - OVERLAP) % 4)
        held = held[len(held) - carried_over :]
    yield held


def opened(segment: str, most: int) -> Iterator[str | None]:
    """The texts that a base64 segment stands for; None is put before the pieces of one that is too large.

    The segment may stand behind a word or path that looks like base64 as well, so it is decoded from
    each of its first four characters on, and what is compressed is looked for anywhere in it. Compressed data is inflated until it is compressed no more or has come up before. Bytes that are not
    UTF-8 are replaced. What only looks like a zlib header may be text, so the data is read as it is, too.
    """
    body = segment.rstrip("=").replace("-", "+").replace("_", "/")
    for k in range(4):
        part = body[k : len(body) - ((len(body) - k) % 4 == 1)]
        if k and len(part) < 16:
            break
        try:
            data = base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
        except (binascii.Error, ValueError):
            return
        if k:
            yield decoded(data)
        else:
            yield from unpacked(data, most)
        for at in compressed_places(data):
            if at or k:
                yield from unpacked(data[at:], most)


def compressed_places(data: bytes) -> Iterator[int]:
    """Where compressed data may begin, behind whatever stands before it: it must go on for some bytes without an error."""
    view = memoryview(data)
    for m in MAGIC.finditer(data):
        try:
            if zlib.decompressobj(47).decompress(view[m.start() : m.start() + 4096], 1 << 16):
                yield m.start()
        except zlib.error:
            pass


def unpacked(data: bytes, most: int) -> Iterator[str | None]:
    """The texts of data that may be compressed, over and over."""
    seen = set()
    while compressed(data) and data not in seen:
        seen.add(data)
        if data[:2] != GZIP:
            yield data.decode(errors="replace")
        parts, first, size = inflate(data, most), [], 0
        for part in parts:
            first.append(part)
            size += len(part)
            if size > most:
                yield None
                for piece in overlapping(chain(first, parts), most):
                    yield piece.decode(errors="replace")
                    if compressed(piece):
                        yield from (x.decode(errors="replace") for x in overlapping(inflate(piece, most), most))
                return
        if not size:
            return
        data = b"".join(first)
    yield decoded(data)


def decoded(data: bytes) -> str:
    """Text of UTF-16 with every second byte zero, or else of UTF-8; what is neither is replaced."""
    for k, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(data) > 15 and data[k::2].count(0) * 10 > len(data[k::2]) * 9 and data[1 - k :: 2].count(0) * 10 < len(data):
            return data.decode(name, errors="replace").removeprefix("\ufeff")
    return data.decode(errors="replace")


def escaped_char(match: str) -> str:
    if match.startswith("&"):
        return html.unescape(match)
    if match[1:].isdigit():
        return chr(int(match[1:], 8))
    code = int(match.strip("\\uUx{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else match


def spliced(text: str, pieces: list[tuple[int, int, str]], starts: np.ndarray, ends: np.ndarray):
    """The text with pieces (start, end, replacement) put in, and the span of each character."""
    out, s, e, at = [], [], [], 0
    for a, b, new in pieces:
        out += [text[at:a], new]
        s += [starts[at:a], np.full(len(new), starts[a])]
        e += [ends[at:a], np.full(len(new), ends[b - 1])]
        at = b
    return "".join([*out, text[at:]]), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]])


def percent_pieces(text: str) -> list[tuple[int, int, str]]:
    """Each escaped character on its own, so that spans stay exact; bytes that are not UTF-8 stay escaped."""
    pieces = []
    for m in PERCENT.finditer(text):
        at = m.start()
        for c in urllib.parse.unquote_to_bytes(m[0]).decode(errors="surrogateescape"):
            bad = "\udc80" <= c <= "\udcff"
            size = 3 if bad else 3 * len(c.encode())
            if not bad:
                pieces.append((at, at + size, c))
            at += size
    return pieces


def segments(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, base64 without line breaks) of what may be encoded; a wrapped segment also line by line."""
    for m in BASE64.finditer(text):
        yield *m.span(), m[0]
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            yield *m.span(), m[0].replace("\r", "").replace("\n", "")


def escapes(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The pieces to put in for percent escapes, and for the other escapes.

    A long chain of escaped escapes is shortened first, in one step; else a text of n characters would have n layers.
    """
    chains = [(*m.span(), m[0][0] + "".join(CHAIN_UNIT.findall(m[0])[-KEPT_UNITS:])) for m in CHAIN.finditer(text)]
    if chains:
        yield chains
        return
    if "%" in text and (pieces := percent_pieces(text)):
        yield pieces
    if "\\" in text or "&" in text:
        pieces = [(*m.span(), c) for m in ESCAPE.finditer(text) if (c := escaped_char(m[0])) != m[0]]
        if pieces:
            yield pieces


def below(text: str, most: int) -> Iterator[str | None]:
    """The next layers of a text whose characters all have one place."""
    for pieces in escapes(text):
        at, out = 0, []
        for a, b, new in pieces:
            out += [text[at:a], new]
            at = b
        yield "".join([*out, text[at:]])
    for _, _, segment in segments(text):
        yield from opened(segment, most)


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for part in parts:
        h.update(len(part).to_bytes(8))
        h.update(part)
    return h.digest()


def within(segment: str, most: int) -> tuple[dict[str, int], int, int]:
    """What a base64 segment holds at any depth, wherever it stands: kinds with the least depth, layers, oversized ones."""
    kinds: dict[str, int] = {}
    n_layers = oversized = 0
    seen: dict[bytes, int] = {}
    stack = [opened(segment, most)]
    while stack:
        try:
            text = next(stack[-1])
        except StopIteration:
            stack.pop()
            continue
        depth = len(stack)
        if text is None:
            oversized += 1
            continue
        key = digest(text.encode(errors="surrogatepass"))
        if not text or seen.get(key, depth + 1) <= depth:
            continue
        spans = scan(text)
        n_layers += key not in seen and bool(spans or not CONTROL.search(text))
        seen[key] = depth
        for kind, _, _ in spans:
            kinds[kind] = min(kinds.get(kind, depth), depth)
        stack.append(below(text, most))
    return kinds, n_layers, oversized


def find_secrets(text: str, most: int = MOST_INFLATED) -> tuple[list[tuple[str, int, int, int]], int, int]:
    """Spans (kind, start, end, depth) by start and kind, number of layers, number of oversized ones.

    Depth 0 is the text itself; a span found at several depths has the least. A layer counts at each place
    of the document, if it is free of control characters or holds a secret.
    """
    found = {s: 0 for s in scan(text)}
    n_layers = oversized = 0
    if "%" in text or "\\" in text or "&" in text or BASE64.search(text):
        known: dict[str, tuple[dict[str, int], int, int]] = {}
        seen: dict[bytes, int] = {}
        counted = set()
        starts = np.arange(len(text))
        work = [(text, starts, starts + 1, 0)]
        while work:
            current, starts, ends, depth = work.pop()
            for a, b, segment in segments(current):
                if segment not in known:
                    known[segment] = within(segment, most)
                kinds, n, large = known[segment]
                if not (kinds or n or large):
                    continue
                place = int(starts[a]), int(ends[b - 1])
                if (segment, place) not in counted:
                    counted.add((segment, place))
                    n_layers += n
                    oversized += large
                for kind, more in kinds.items():
                    found[(kind, *place)] = min(found.get((kind, *place), depth + more), depth + more)
            for pieces in escapes(current):
                layer, s, e = spliced(current, pieces, starts, ends)
                key = digest(layer.encode(errors="surrogatepass"), s.tobytes(), e.tobytes())
                if not layer or seen.get(key, depth + 2) <= depth + 1:
                    continue
                n_layers += key not in seen
                seen[key] = depth + 1
                work.append((layer, s, e, depth + 1))
                for kind, a, b in scan(layer):
                    span = (kind, int(s[a]), int(e[b - 1]))
                    found[span] = min(found.get(span, depth + 1), depth + 1)
    order = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, found[s]) for s in order], n_layers, oversized


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_inflated: int = MOST_INFLATED) -> DataFrame:
    """``keep`` and, for each document, spans (code points, end exclusive), n_layers and n_oversized."""

    def run(batches):
        for batch in slices(batches):
            spans, n_layers, oversized = [], [], []
            for text in column(batch, "text").to_pylist():
                found, n, large = find_secrets(text or "", most_inflated)
                spans.append([{"kind": k, "start": a, "end": b, "depth": d} for k, a, b, d in found])
                n_layers.append(n)
                oversized.append(large)
            yield carried(batch, keep, {"spans": pa.array(spans, SPANS), "n_layers": pa.array(n_layers, pa.int32()), "n_oversized": pa.array(oversized, pa.int32())})

    columns = tuple(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(run, schema_with(docs, keep, RESULT))
