"""Operator 1: benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Every run of
``window`` consecutive words of a benchmark item is a pattern; an item with fewer words, but not
none, is one pattern. Patterns are grouped by length, and each group has its own Wu-Manber tables,
so that a short item does not shorten the jumps of the others.

Defined results: a null or empty text has no words and no hits; a benchmark row with a null item_id
or null text holds no patterns; repeated rows of either table are scanned like any other, and an
item that is there twice counts once; an empty benchmark hits nothing. Only the columns named in
``keep`` are carried, so extra columns cannot clash.

Patterns reach the tasks in blocks of at most ``block_bytes`` of benchmark text. A benchmark of more
text takes several passes over the documents, each adding to the hits of the one before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column, schema_with, slices, stored, text_bytes, utf8

WINDOW = 13
BLOCK_BYTES = 16 << 20
RESULT = "n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: A-Z to lower case; digits, letters and bytes of non-ASCII characters stay; all else separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Patterns:
    """Wu-Manber tables over word numbers for patterns of one length."""

    def __init__(self, length: int, base: int):
        self.length, self.base = length, base
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[list[int], list[str]]]] = {}

    def key(self, ids: list[int], end: int) -> int:
        return ids[end] if self.block == 1 else ids[end - 1] * self.base + ids[end]

    def add(self, ids: list[int], items: list[str]) -> None:
        for end in range(self.block - 1, self.length):
            key = self.key(ids, end)
            self.shift[key] = min(self.shift.get(key, self.jump), self.length - 1 - end)
        self.bucket.setdefault(self.key(ids, self.length - 1), []).append((ids, items))

    def search(self, ids: list[int]) -> Iterator[tuple[int, list[str]]]:
        """Start of each occurrence and the items that have it."""
        shift, jump, base, m, two = self.shift.get, self.jump, self.base, self.length, self.block == 2
        at, n = m - 1, len(ids)
        while at < n:
            key = ids[at - 1] * base + ids[at] if two else ids[at]
            skip = shift(key, jump)
            if skip:
                at += skip
                continue
            found = ids[at - m + 1 : at + 1]
            for pattern, items in self.bucket[key]:
                if pattern == found:
                    yield at - m + 1, items
            at += 1


class PatternSet:
    """The patterns of some benchmark items, with the numbering of their words; 0 is any other word."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text.encode())]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                windows.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.groups: dict[int, Patterns] = {}
        for ids, items in windows.items():
            size = len(ids)
            if size not in self.groups:
                self.groups[size] = Patterns(size, len(self.number) + 1)
            self.groups[size].add(list(ids), sorted(items))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        get = self.number.get
        ids = [get(w, 0) for w in words]
        spans, items = [], set()
        for group in self.groups.values():
            for start, found in group.search(ids):
                spans.append((start, start + group.length))
                items.update(found)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` and, for each document, n_words, spans of hit words (start, end) and the items that occur."""
    spark = docs.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    blocks = max(1, math.ceil(text_bytes(items) / block_bytes))
    keep_text = tuple(dict.fromkeys([*keep, "text"]))
    out = docs.select(*keep_text)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        patterns = spark.sparkContext.broadcast(PatternSet([tuple(r) for r in part.distinct().collect()], window))
        first, last = k == 0, k == blocks - 1
        columns = keep if last else keep_text

        def scan(batches, patterns=patterns, first=first, columns=columns):
            known = patterns.value
            for batch in slices(batches):
                n_words, spans, names = [], [], []
                before = None if first else (column(batch, "spans").to_pylist(), column(batch, "items").to_pylist())
                for i, text in enumerate(utf8(batch)):
                    words = words_of(text)
                    found, items = known.scan(words)
                    if before:
                        found += [(s["start"], s["end"]) for s in before[0][i]]
                        items |= set(before[1][i])
                    n_words.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(found)])
                    names.append(sorted(items))
                yield carried(batch, columns, {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, SPANS), "items": pa.array(names, pa.list_(pa.string()))})

        out = out.mapInArrow(scan, schema_with(docs, columns, RESULT))
        if blocks > 1:
            # Each pass is done with before the next begins, so that no worker and no driver holds two blocks.
            out = stored(out)
            patterns.destroy()
    return out


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The contract's rule: some word is hit, and at least a twentieth of them."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def with_hits(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit)


def decontaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The documents that are not contaminated."""
    found = with_hits(find_contamination(docs, benchmark, keep))
    return found.where(~contaminated()).select(*keep)
