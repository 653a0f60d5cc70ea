"""Operator 3: packing documents into training sequences under mixture control.

Documents are tokenised and dealt to shards by a hash, so that no source, however large, meets in
one task. The stream of all shards, in order, is cut into sequences of ``SEQUENCE`` tokens. Within a
shard a deficit round-robin over the queues of the sources fills each window of ``WINDOW`` tokens of
the stream: a source earns its share of the window, is served what it has earned as far as its
queue goes, and carries the rest, its deficit, into the next window. What a source has been served
before a shard begins follows from sums over the shards before it, so deficits pass from shard to
shard without running the shards one after another. The target shares are the sources' shares of all
tokens unless ``targets`` names others; room that the named shares cannot fill goes to the sources
that still have tokens, and counts against them.

A shard begins where the one before ends, within a sequence or a window, so the only padding is that
of the last sequence of all.

Defined results: a null or empty text is its end token alone; a null source is a queue of its own; a
null doc_id is packed like any other; repeated rows are packed each time; no documents give no
pieces. A document may be cut anywhere; its pieces keep its order within the stream.
"""

from __future__ import annotations

import math
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, schema_with, slices, stored

SEQUENCE = 2048
WINDOW = 32 * SEQUENCE
SHARD_TOKENS = 4_000_000
END = 1
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 600_000
PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_words: dict[str, WordIds] = {}


PROBES = ("hello", "the", "éclair", "straße", "ñandú", "überœuvre", "zzzq", "a")
#: Bytes as the printable characters that byte-level vocabularies use: those that print stand for themselves.
PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_CHARS = {b: chr(b) for b in PRINTS} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTS)}


class WordIds(dict):
    """Token ids of words between blanks, as bytes; those it has not are looked up and kept.

    A tokenizer that drops white space never joins what a blank separates, so the ids of a text are
    those of its words in turn. A word that ends in a letter and then dots or commas is put together
    from its parts, and a word of Latin letters goes to the vocabulary directly, past the parts of
    the tokenizer that would leave it as it is. Both are used only if the probes confirm them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        each = [self.full(w) for w in PROBES]
        self.splits = self.full(" ".join(PROBES)) == sum(each, []) and self.full("Hello.,\nhello") == self.full("hello") + self.full(".,") + self.full("hello")
        self.direct = self.splits and [self.short(w) for w in PROBES] == each

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind.char}", *ids)

    def full(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def short(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.model.tokenize(word)]

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(".,")
        if self.direct and body.isalpha() and (body.isascii() or max(body) < "\u0250" and "\u0130" not in body):
            low = body.lower()
            if low != word:
                ids = self[low] + (self[word[len(body) :]] if len(body) < len(word) else b"")
            else:
                ids = self.packed(self.short(low))
        else:
            ids = self.packed(self.full(word))
        self[word] = ids
        return ids

    def texts(self, texts: list[str], end: int) -> list[bytes]:
        last = np.array([end], self.kind).tobytes()
        if not self.splits:
            return [np.array(x.ids, self.kind).tobytes() + last for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self) > CACHED_WORDS:
            self.clear()
        return [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) + last for t in texts]


def word_ids(path: str) -> WordIds:
    """One table for each process and tokenizer."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def tokenize(docs: DataFrame, keep: tuple[str, ...], tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """``keep``, n (tokens, the end token included) and ids (little-endian, ``width`` bytes each)."""

    def run(batches):
        known = word_ids(tokenizer)
        for batch in slices(batches, most=1 << 20):
            ids = known.texts([t or "" for t in column(batch, "text").to_pylist()], end)
            n = [len(x) // known.kind.itemsize for x in ids]
            kept = [column(batch, c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array([known.kind.itemsize] * len(n), pa.int32()), pa.array(ids, pa.binary())], names=[*keep, "n", "width", "ids"])

    columns = tuple(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(run, schema_with(docs, keep, "n bigint, width int, ids binary"))


def served(queued: np.ndarray, share: np.ndarray, credit: np.ndarray, start: int, window: int) -> list[tuple[int, int]]:
    """Deficit round-robin: (queue, tokens) in the order of service, until all queues are empty."""
    left, credit, order = queued.copy(), credit.copy(), []
    at, stop = start, start + int(queued.sum())
    while at < stop:
        room = min(window - at % window, stop - at)
        credit += share * room
        take = np.minimum(np.maximum(np.floor(credit), 0).astype(np.int64), left)
        over = int(take.sum()) - room
        for s in np.argsort(credit, kind="stable"):
            if over <= 0:
                break
            less = min(over, int(take[s]))
            take[s] -= less
            over -= less
        rest = room - int(take.sum())
        while rest > 0:
            spare = left - take
            open_ = spare > 0
            weight = np.where(open_, np.maximum(share, 1e-12), 0)
            more = np.minimum(spare, np.floor(rest * weight / weight.sum()).astype(np.int64))
            if not more.any():
                s = int(np.argmax(np.where(open_, credit - take, -np.inf)))
                more[s] = min(int(spare[s]), rest)
            take += more
            rest -= int(more.sum())
        first = (at // window) % len(left)
        order += [(s, int(take[s])) for s in [*range(first, len(left)), *range(first)] if take[s]]
        credit -= take
        left -= take
        at += room
    return order


def pieces_of(docs: list[list[tuple[int, int]]], order: list[tuple[int, int]], start: int, sequence: int):
    """(row, first token, tokens, place in the stream) for the tokens served; ``docs`` are (row, tokens) by queue."""
    head = [0] * len(docs)
    done = [0] * len(docs)
    at = start
    for s, tokens in order:
        while tokens:
            row, size = docs[s][head[s]]
            n = min(tokens, size - done[s], sequence - at % sequence)
            yield row, done[s], n, at
            done[s] += n
            at += n
            tokens -= n
            if done[s] == size:
                head[s] += 1
                done[s] = 0


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), targets: dict[str, float] | None = None, tokenizer: str = TOKENIZER, end: int = END, sequence: int = SEQUENCE, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: ``keep``, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset."""
    carry = tuple(dict.fromkeys([*keep, "doc_id", "source"]))
    tokens = stored(tokenize(docs, carry, tokenizer, end))
    by_source = tokens.groupBy("source").agg(F.sum("n").alias("total"))
    total = by_source.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_tokens))
    dealt = tokens.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "source", "ids"), F.lit(shards)).cast("int"))
    cells = dealt.groupBy("_shard", "source").agg(F.sum("n").alias("n"))
    sizes = cells.groupBy("_shard").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("begin", F.sum("size").over(W.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)))
    cells = cells.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)))
    if targets is None:
        wanted = by_source.select(F.col("source").alias("_s"), (F.col("total") / F.lit(max(total, 1))).alias("share"))
    else:
        rows = [(s, float(x) / sum(targets.values())) for s, x in targets.items()]
        wanted = docs.sparkSession.createDataFrame(rows, "_s string, share double")
    plan = (
        cells.join(wanted, F.col("source").eqNullSafe(F.col("_s")), "left").join(sizes, "_shard")
        .select(F.col("_shard").alias("_part"), F.col("source").alias("_source"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("begin", F.lit(0)).alias("begin"))
    )

    def run(key, docs_, plan_):
        docs_ = docs_.combine_chunks()
        sources = sorted(set(docs_["source"].to_pylist()), key=lambda s: (s is None, s))
        number = {s: i for i, s in enumerate(sources)}
        begin = plan_["begin"][0].as_py()
        share, before = np.zeros(len(sources)), np.zeros(len(sources))
        for s, x, b in zip(plan_["_source"].to_pylist(), plan_["share"].to_pylist(), plan_["before"].to_pylist()):
            share[number[s]], before[number[s]] = x, b
        n = docs_["n"].to_numpy()
        ids = docs_["ids"].to_pylist()
        width = np.dtype(f"<u{docs_['width'][0].as_py()}")
        queues: list[list[tuple[int, int]]] = [[] for _ in sources]
        names = [number[s] for s in docs_["source"].to_pylist()]
        doc_ids = docs_["doc_id"].to_pylist()
        for i in sorted(range(len(ids)), key=lambda i: (doc_ids[i] is None, 0 if doc_ids[i] is None else doc_ids[i], ids[i])):
            queues[names[i]].append((i, int(n[i])))
        queued = np.array([sum(x for _, x in q) for q in queues], np.int64)
        order = served(queued, share, share * begin - before, begin, window)
        rows, starts, sizes_, places, blobs = [], [], [], [], []
        for row, first, size, at in pieces_of(queues, order, begin, sequence):
            rows.append(row)
            starts.append(first)
            sizes_.append(size)
            places.append(at)
            blobs.append(np.frombuffer(ids[row], width)[first : first + size].astype("<u4").tobytes())
        taken = docs_.select(list(keep)).take(pa.array(rows, pa.int64()))
        at = np.array(places, np.int64)
        found = {
            "start": pa.array(starts, pa.int64()), "length": pa.array(sizes_, pa.int64()), "ids": pa.array(blobs, pa.binary()),
            "doc_tokens": pa.array(n[rows], pa.int64()), "sequence_id": pa.array(at // sequence), "offset": pa.array(at % sequence),
        }
        return pa.table([*taken.columns, *found.values()], names=[*keep, *found])

    return dealt.groupBy("_shard").cogroup(plan.groupBy("_part")).applyInArrow(run, schema_with(docs, keep, PIECES))
