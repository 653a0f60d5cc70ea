"""Operator 9: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes, each at its position. Two fingerprints that differ in at
most four bits differ in at most four bytes, so they share four positional bytes at least, and
among any seven of the positions three. The index therefore posts each distinct fingerprint under
the 35 triples of its first seven bytes. Within a posting list the shared positional bytes of a pair
are tallied, pairs below four are dropped, and the rest are verified by their differing bits. A list
gives a spanning forest of its links, never all its pairs: short lists are compared side by side,
long ones by a search that compares what it reaches only with what it has not reached.

Defined results: a null or empty text has no words and fingerprint zero, and links like any other;
repeated rows are copies of each other; a null doc_id is never the name of a component unless all of
its documents have none. Exact copies meet in the fingerprint table before the index, so a group of
copies of any size is one entry there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, schema_with, slices, stored, utf8
from .graph import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
BYTES = 8
LONG_LIST = 48
MOST_LIST = 20_000


def hashes(text: bytes) -> list[int]:
    """XXH64 of each shingle of words, of the whole sequence if it is shorter than one."""
    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [h(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[: -SHINGLE]).tolist()
    return [h(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    for a in range(0, len(texts)):
        found = np.array(hashes(texts[a]), dtype=">u8")
        if len(found):
            ones = np.zeros(64, np.int64)
            for k in range(0, len(found), 1 << 16):
                bits = np.unpackbits(found[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.int32)
            out[a] = np.packbits(2 * ones > len(found)).view(">u8")[0]
    return out


def fingerprint(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp, the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in slices(batches):
            yield carried(batch, keep, {"fp": pa.array(fingerprints_of(utf8(batch)).view(np.int64), pa.int64())})

    columns = tuple(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(run, schema_with(docs, keep, "fp bigint"))


def posted(batches, shared: int, split: bool = False):
    """(key, fp): the fingerprint under each choice of ``shared`` of its first positions.

    ``split`` adds to each choice, in turn, one of five pieces of the bits it leaves out: as four of
    those may differ at most, one piece is the same in any two that are linked.
    """
    choices = list(combinations(range(BYTES - MOST_BITS + shared), shared))
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        at = [(fp >> np.uint64(8 * p)) & np.uint64(255) for p in range(BYTES)]
        for n, chosen in enumerate(choices):
            key = np.full(len(fp), n, np.uint64)
            for p in chosen:
                key = (key << np.uint64(8)) | at[p]
            if not split:
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])
                continue
            rest = np.zeros(len(fp), np.uint64)
            left = [p for p in range(BYTES) if p not in chosen]
            for p in left:
                rest = (rest << np.uint64(8)) | at[p]
            edges = [8 * len(left) * k // (MOST_BITS + 1) for k in range(MOST_BITS + 2)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                piece = (rest >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                own = (((key << np.uint64(3)) | np.uint64(k)) << np.uint64(8)) | piece
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tally the shared positional bytes, keep what reaches the guaranteed number, verify its bits."""
    differ = x ^ y
    tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    ok = tally >= BYTES - MOST_BITS
    ok[ok] = np.bitwise_count(differ[ok]) <= MOST_BITS
    return ok


def search(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links of one long list."""
    a, b, left = [], [], fps
    while len(left) > 1:
        work, left = [left[:1]], left[1:]
        while work and len(left):
            here = work.pop()
            for x in here:
                ok = linked(np.full(len(left), x), left)
                if ok.any():
                    near = left[ok]
                    a.append(np.full(len(near), x))
                    b.append(near)
                    work.append(near)
                    left = left[~ok]
                    if not len(left):
                        break
    return a, b


def links_of(batches, most_list: int):
    """Links within each posting list of rows sorted by key; (fp, null) for the members of a list that is too long."""

    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64)) if b is not None else pa.nulls(len(a), pa.int64())], names=["a", "b"])

    def whole(keys, fps):
        """Lists that are complete."""
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(keys)))
        for s, n in zip(begin[size > LONG_LIST].tolist(), size[size > LONG_LIST].tolist()):
            a, b = search(fps[s : s + n])
            if a:
                yield emit(np.concatenate(a), np.concatenate(b))
        at = np.flatnonzero(np.repeat((size > 1) & (size <= LONG_LIST), size))
        for step in range(1, LONG_LIST):
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            if not len(at):
                break
            ok = at[linked(fps[at], fps[at + step])]
            if len(ok):
                yield emit(fps[ok], fps[ok + step])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    over = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if over is not None:
            n = int(np.searchsorted(keys, over, side="right"))
            if n:
                yield emit(fps[:n], None)
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            over = None
        if held:
            keys, fps = np.concatenate([held[0][0], keys]), np.concatenate([held[0][1], fps])
        n = int(np.searchsorted(keys, keys[-1]))
        yield from whole(keys[:n], fps[:n])
        held = [(keys[n:], fps[n:])]
        if len(keys) - n > most_list:
            over, held = keys[-1], []
            yield emit(fps[n:], None)
    if held:
        yield from whole(*held[0])


def links(fps: DataFrame, most_list: int = MOST_LIST) -> DataFrame:
    """(a, b): links that span the same components as all links between distinct fingerprints.

    A list of over ``most_list`` members is not held by a task: its members are posted once more,
    under the choices of four bytes of all eight, which every link shares as well, each with a piece of
    the other four. What shares 38 bits there is few, and is searched however many they are.
    """

    def index(rows: DataFrame, shared: int, most: int, split: bool) -> DataFrame:
        posts = rows.mapInArrow(lambda it: posted(it, shared, split), "key bigint, fp bigint")
        return stored(posts.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: links_of(it, most), "a bigint, b bigint"))

    found = index(fps.select("fp"), 3, most_list, False)
    again = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if again.isEmpty():
        return found
    return found.where("b IS NOT NULL").unionByName(index(again, 4, 1 << 62, True))


def with_roots(docs: DataFrame, keep: tuple[str, ...], most_list: int = MOST_LIST) -> DataFrame:
    """``keep``, fp, root (the fingerprint that names the component) and component_id for each document."""
    marked = stored(fingerprint(docs, tuple(dict.fromkeys([*keep, "doc_id"]))))
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(fps, most_list))
    rooted = fps.join(stars, fps.fp == stars.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select(*keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_list: int = MOST_LIST) -> DataFrame:
    """``keep``, fp and component_id (the least doc_id of the component) for each document."""
    return with_roots(docs, keep, most_list).select(*keep, "fp", "component_id")


def near_unique(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One document of each component: that of the least doc_id, and of rows alike in all of ``keep`` one.

    Components are told apart by their roots; ids may be null or repeated, so component_id does not name one.
    """
    tag = F.xxhash64(*keep).alias("_tag")
    marked = with_roots(docs.select(*keep, tag), ("doc_id", "_tag"))
    best = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tag")).alias("best"))
    first = stored(marked.groupBy("doc_id", "_tag").agg(F.count("*").alias("_n")).join(best.select(F.col("best.doc_id").alias("_id"), F.col("best._tag").alias("_t")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("_t")), "left_semi"))
    first = first.select(F.col("doc_id").alias("_id"), F.col("_tag").alias("_t"), "_n")
    rows = docs.select(*keep, tag)
    chosen = lambda which: rows.join(which, (F.col("_tag") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*keep)
    repeated = first.where("_n > 1")
    if repeated.isEmpty():
        return chosen(first)
    return chosen(first.where("_n = 1")).unionByName(chosen(repeated).dropDuplicates())
