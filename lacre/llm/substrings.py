"""Operator 10: removal of repeated passages by fixed-block anchors.

A window of ``window`` words holds at least one of the non-overlapping blocks of (window + 1) / 2
words that a document is laid out in. Those blocks are indexed by hash, every rolling window of a
block's length probes the index, and a hit that another position shares is an anchor. Each window
around an anchor is then looked up by its hash and by a BLAKE2 digest of its words themselves, so
that a collision of hashes removes nothing; runs of windows that start somewhere else too are the
maximal exact repeats, and their words are removed.

Hashes travel as sorted lists, one for each pair of a batch of documents and a range of hashes, so
that a window costs a few bytes of shuffle. A batch sends each hash once, with a mark if it has it
at several positions; a passage that a third of the documents share is thus one entry a batch, and
no pair of documents is ever formed. Batches and ranges hold a fixed amount of text each and grow in
number with the input. The first lookup is a filter and may let a false anchor through; the second
decides. Documents keep the batch they are dealt to when a task is run again.

Defined results: a null or empty text has no words and keeps none; a text shorter than a window
loses nothing, however often it is there; repeated rows are copies and remove each other; a null
doc_id is kept as it is.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, schema_with, text_bytes

WINDOW = 35
BATCH_BYTES = 8 << 20
RANGE_BYTES = 12 << 20
PIECE = 4 << 20
LISTS = "range int, batch int, n int, base bigint, planes int, hashes binary, extra binary, marks binary"
FOUND = "batch int, hashes binary, extra binary"
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
S = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> S)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word between blanks, taken eight bytes at a time."""
    n = len(text)
    data = np.frombuffer(text + b" " * 8, np.uint8)
    word = ~BLANK[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.append(0, edge)
    starts, ends = edge[0::2], edge[1::2]
    size = ends - starts
    eight = np.ndarray((n + 1,), "<u8", buffer=data, strides=(1,))
    out = mixed(size.astype(np.uint64) * M3)
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (left % np.uint64(8)))) - np.uint64(1))
        out[todo] = mixed((out[todo] ^ (eight[starts[todo] + at] & mask)) * M1)
        at += 8
        todo = todo[size[todo] > at]
    return out


def pieces(text: bytes):
    """A text cut between words."""
    at = 0
    while len(text) - at > PIECE:
        data = np.frombuffer(text, np.uint8, PIECE, at)
        blank = np.flatnonzero(BLANK[data[-65536:]])
        if not len(blank):
            blank = np.flatnonzero(BLANK[data])
            end = at + int(blank[-1]) + 1 if len(blank) else len(text)
        else:
            end = at + PIECE - min(65536, PIECE) + int(blank[-1]) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, and where each text's begin, with the end."""
    parts, counts = [np.zeros(0, np.uint64)], []
    for text in texts:
        found = [word_hashes(p) for p in pieces(text)] if text else []
        counts.append(sum(map(len, found)))
        parts += found
    return np.concatenate(parts), np.cumsum([0, *counts])


def rolling(words: np.ndarray, size: int, multiplier: np.uint64) -> np.ndarray:
    """Hash of the ``size`` words from each position on, put together from powers of two."""

    def joined(a, a_size, b, b_size):
        n = len(words) - a_size - b_size + 1
        return mixed(a[:n] * multiplier + b[a_size : a_size + n])

    if len(words) < size:
        return np.zeros(0, np.uint64)
    power, length, out, done = words, 1, None, 0
    while length <= size:
        if size & length:
            out, done = (power, length) if out is None else (joined(out, done, power, length), done + length)
        if 2 * length <= size:
            power = joined(power, length, power, length)
        length *= 2
    return out


class Batch:
    """The word hashes of some documents and which positions begin a window within one."""

    def __init__(self, texts: list[bytes], window: int):
        self.texts = texts
        self.words, self.bounds = hashed(texts)
        self.window, self.block = window, (window + 1) // 2
        size = np.diff(self.bounds)
        end = np.repeat(self.bounds[1:], size)
        at = np.arange(len(self.words))
        self.long = np.repeat(size >= window, size)
        self.fits_block = self.long & (at + self.block <= end)
        self.fits_window = self.long & (at + window <= end)
        self.aligned = (at - np.repeat(self.bounds[:-1], size)) % self.block == 0

    def blocks(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rolling windows of a block's length, and their hashes' first bits."""
        at = np.flatnonzero(self.fits_block)
        return at, rolling(self.words, self.block, M1)[at] >> np.uint64(64 - bits)

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Positions of the windows that hold an anchor."""
        count = np.cumsum(np.append(0, np.bincount(anchors, minlength=len(self.words))))
        at = np.flatnonzero(self.fits_window)
        return at[count[at + self.window - self.block + 1] > count[at]]

    def windows(self, at: np.ndarray) -> np.ndarray:
        return rolling(self.words, self.window, M1)[at]

    def digests(self, at: np.ndarray) -> np.ndarray:
        """A digest of the words of each window, in the order of the positions."""
        out = np.empty(len(at), np.uint64)
        cuts = np.searchsorted(at, self.bounds)
        blake, window = hashlib.blake2b, self.window
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            words = self.texts[d].split()
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            own = at[cuts[d] : cuts[d + 1]] - self.bounds[d]
            starts = np.where(own > 0, ends[own - 1], 0).tolist()
            stops = (ends[own + window - 1] - 1).tolist()
            found = b"".join([blake(joined[a:b], digest_size=8).digest() for a, b in zip(starts, stops)])
            out[cuts[d] : cuts[d + 1]] = np.frombuffer(found, "<u8")
        return out


def lists(batch: int, hashes: np.ndarray, extra: np.ndarray | None, marks: np.ndarray, bits: int, ranges: int) -> pa.Table:
    """The sorted hashes of a batch, each once, as one row for each range of hashes.

    ``marks`` are 2 for an indexed block; 1 is added where a hash has several positions.
    """
    order = np.argsort(hashes, kind="stable") if extra is None else np.lexsort((extra, hashes))
    hashes, marks = hashes[order], marks[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    if extra is not None:
        extra = extra[order]
        new[1:] |= extra[1:] != extra[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(hashes))) > 1
    marks = np.bitwise_or.reduceat(marks, first) | many if len(first) else marks
    hashes = hashes[first]
    extra = extra[first] if extra is not None else None
    top = hashes >> np.uint64(max(bits - 32, 0)) if bits >= 32 else hashes << np.uint64(32 - bits)
    which = (top * np.uint64(ranges)) >> S
    cuts = np.searchsorted(which, np.arange(ranges + 1, dtype=np.uint64))
    rows = []
    for r in range(ranges):
        a, b = int(cuts[r]), int(cuts[r + 1])
        if b > a:
            steps = np.diff(hashes[a:b], prepend=hashes[a : a + 1])
            planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
            packed = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
            rows.append((r, batch, b - a, int(hashes[a : a + 1].view(np.int64)[0]), planes, packed, b"" if extra is None else extra[a:b].tobytes(), marks[a:b].astype(np.uint8).tobytes()))
    names = ["range", "batch", "n", "base", "planes", "hashes", "extra", "marks"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)


def shared(rows):
    """Of the lists of one range: for each batch its hashes that have several positions, one of them indexed."""
    batches, hashes, extra, marks = [], [], [], []
    for r in rows.to_pylist():
        steps = np.zeros((r["n"], 8), np.uint8)
        steps[:, : r["planes"]] = np.frombuffer(r["hashes"], np.uint8).reshape(r["planes"], -1).T
        hashes.append(np.cumsum(steps.view("<u8").ravel()) + np.int64(r["base"]).view(np.uint64))
        extra.append(np.frombuffer(r["extra"], np.uint64) if r["extra"] else np.zeros(r["n"], np.uint64))
        marks.append(np.frombuffer(r["marks"], np.uint8))
        batches.append(np.full(r["n"], r["batch"], np.int32))
    batches, hashes, extra, marks = map(np.concatenate, (batches, hashes, extra, marks))
    order = np.lexsort((extra, hashes)) if extra.any() else np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (extra[order][1:] != extra[order][:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(1 + (marks[order] & 1).astype(np.int64), first)
    indexed = np.bitwise_or.reduceat(marks[order], first) & 2
    good = np.repeat((count > 1) & (indexed > 0), np.diff(np.append(first, len(order))))
    hit = order[good]
    hit = hit[np.argsort(batches[hit], kind="stable")]
    which, begin = np.unique(batches[hit], return_index=True)
    stop = np.append(begin[1:], len(hit))
    cut = [hit[a:b] for a, b in zip(begin, stop)]
    return pa.table([pa.array(which, pa.int32()), pa.array([hashes[c].tobytes() for c in cut], pa.binary()), pa.array([extra[c].tobytes() for c in cut], pa.binary())], names=["batch", "hashes", "extra"])


def listed(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All hashes that were found for a batch."""
    return (
        np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in found["hashes"].to_pylist())]),
        np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in found["extra"].to_pylist())]),
    )


def texts_of(docs: pa.Table) -> list[bytes]:
    return [x or b"" for x in docs["text"].cast(pa.binary()).to_pylist()]


def among(h: np.ndarray, extra: np.ndarray, known: np.ndarray, known_extra: np.ndarray) -> np.ndarray:
    """Whether each pair of hash and digest is a known one."""
    order = np.lexsort((known_extra, known))
    known, known_extra = known[order], known_extra[order]
    at = np.searchsorted(known, h)
    found = np.zeros(len(h), bool)
    todo = np.arange(len(h))
    while len(todo):
        todo = todo[at[todo] < len(known)]
        todo = todo[known[at[todo]] == h[todo]]
        found[todo] |= known_extra[at[todo]] == extra[todo]
        at[todo] += 1
    return found


def covered(batch: Batch, at: np.ndarray) -> np.ndarray:
    """Which words lie in a window that begins at one of the positions."""
    edge = np.zeros(len(batch.words) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + batch.window, 1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, of_files: bool = False) -> DataFrame:
    """``keep``, n_words, n_removed, kept (the words that stay, joined by blanks) and its SHA-256; ``of_files``: see ``numbered``."""
    total = text_bytes(docs)
    n_batches, n_ranges = max(1, math.ceil(total / BATCH_BYTES)), max(1, math.ceil(total / RANGE_BYTES))
    bits = min(62, max(24, math.ceil(math.log2(total + 2)) + 10))
    columns = tuple(dict.fromkeys([*keep, "text"]))
    dealt = numbered(docs, of_files).select(*columns, F.pmod(F.xxhash64("_row"), F.lit(n_batches)).cast("int").alias("_batch"))

    def index(key, rows):
        batch = Batch(texts_of(rows), window)
        at, h = batch.blocks(bits)
        return lists(key[0].as_py(), h, None, np.where(batch.aligned[at], 2, 0).astype(np.uint8), bits, n_ranges)

    def anchor(key, rows, found):
        batch = Batch(texts_of(rows), window)
        at, h = batch.blocks(bits)
        near = batch.around(at[np.isin(h, listed(found)[0])])
        h = batch.windows(near) if len(near) else np.zeros(0, np.uint64)
        return lists(key[0].as_py(), h, batch.digests(near), np.full(len(h), 2, np.uint8), 64, n_ranges)

    def cut(key, rows, found):
        texts = texts_of(rows)
        batch = Batch(texts, window)
        known, known_extra = listed(found)
        at = np.flatnonzero(batch.fits_window)
        if len(known) and len(at):
            h = batch.windows(at)
            maybe = np.isin(h, known)
            at, h = at[maybe], h[maybe]
            at = at[among(h, batch.digests(at), known, known_extra)]
        else:
            at = at[:0]
        gone = covered(batch, at)
        removed = np.add.reduceat(np.append(gone, False), batch.bounds[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        n_words = np.diff(batch.bounds)
        removed = np.where(n_words > 0, removed, 0)
        kept = []
        for i, text in enumerate(texts):
            words = text.split()
            if removed[i]:
                mask = gone[batch.bounds[i] : batch.bounds[i + 1]].tolist()
                words = [w for w, g in zip(words, mask) if not g]
            kept.append(b" ".join(words))
        out = {
            "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        return pa.table([*(rows[c] for c in keep), *out.values()], names=[*keep, *out])

    def both(found: DataFrame, run, schema: str) -> DataFrame:
        back = found.groupBy("range").applyInArrow(shared, FOUND).select(F.col("batch").alias("_to"), "hashes", "extra")
        return dealt.groupBy("_batch").cogroup(back.groupBy("_to")).applyInArrow(run, schema)

    anchors = dealt.groupBy("_batch").applyInArrow(index, LISTS)
    windows = both(anchors, anchor, LISTS)
    return both(windows, cut, schema_with(docs, keep, "n_words bigint, n_removed bigint, kept string, kept_sha256 string"))
