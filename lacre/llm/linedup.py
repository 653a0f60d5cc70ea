"""Operator 5: line deduplication by a segment-partition edit join.

Two lines are linked if they differ by ``most_edits`` edits at most and by no more than one edit for
each ``chars_per_edit`` characters of the longer one, so that a fifth of a line may differ and no more:
lines of ten characters and more within two edits, of five to nine within one, shorter ones if they
are equal. For each number of edits that a longer line allows, it and the lines that may be linked to
it are split into one more segments; at least one of them must occur unchanged, and nearly in place,
in any line linked to it. Each line posts its segments under (edits, length, segment, text), and
probes, for its own and each shorter length in reach, the substrings that may hold a segment (the
multi-match-aware choice: segment i may have moved by i - 1 places at most, counted from either end).
What meets under a key is tested by the parity of its characters, of which an edit changes two at
most, and then verified by a banded bit-parallel edit distance.

A crowded key is dealt out once more, by pieces of the parity: parities that differ in few bits agree
in one piece at least, so each part of the key is a task's work of its own and no link is lost. A part
that is still crowded is cut into blocks, and each two blocks meet in a cell of bounded size.

Equal lines are one entry from the start: they are dropped within a task before keys are made and
within a key afterwards, so a line that a third of the rows hold is a few rows in the join. The
classes are the components of the links; a class is named by its first line in the order of doc_id
and line number.

Defined results: a null text has no lines; blank lines (of white space of any alphabet, so that of a
text with carriage returns as well) are nobody's copies and keep their place;
a null doc_id comes after all others; in repeated rows the lines of one are copies of the other's.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, numbered, slices, stored
from .graph import components

MOST_EDITS = 2
CHARS_PER_EDIT = 5
SHORT_RUN = 8
#: A longer run is handed on whole, to be dealt out by pieces of the parity before its pairs are looked at.
LONG_RUN = 4096
#: A part with more members is cut into blocks of about as many.
LONG_PART = 50_000
MOST_BROADCAST = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for k, x in enumerate((BASE, inverse)):
                _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)]))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(length: np.ndarray, count: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the i-th of ``count`` segments: the last ones are a character longer where it doesn't come out even."""
    size, rest = length // count, length % count
    longer = np.maximum(i - (count - rest), 0)
    return i * size + longer, size + (i >= count - rest)


def keys_of(lines: list[str], most_edits: int, chars_per_edit: int = CHARS_PER_EDIT):
    """(key, which line, probe) of every segment and probe, and the lines' parity signatures.

    A key under which a line both posts and probes is a posting.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(length) - length
    up, down = powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])
    parity = np.bitwise_xor.reduceat(np.uint32(1) << (mixed(codes * BASE) & np.uint64(31)).astype(np.uint32), begin)
    out = []
    for edits in range(1, most_edits + 1):
        probes = (length >= edits * chars_per_edit) & ((edits == most_edits) | (length < (edits + 1) * chars_per_edit))
        posts = probes | (length >= edits * chars_per_edit - edits) & (length < edits * chars_per_edit)
        for less in range(edits + 1):
            target = length - less
            for i in range(edits + 1):
                at, size = segments(target, edits + 1, i)
                low, high = max(-i, less - (edits - i)), min(i, less + edits - i)
                for shift in range(low, high + 1):
                    start, probe = at + shift, less > 0 or shift != 0
                    ok = np.flatnonzero((probes if probe else posts) & (start >= 0) & (start + size <= length) & (size > 0))
                    a = begin[ok] + start[ok]
                    text = (sums[a + size[ok]] - sums[a]) * down[a]
                    key = mixed(text ^ mixed((target[ok].astype(np.uint64) * np.uint64(64) + np.uint64(8 * edits + i)) * BASE))
                    out.append((key, ok, np.full(len(ok), probe)))
    return tuple(map(np.concatenate, zip(*out))), parity


def posted(batches, most_edits: int, chars_per_edit: int):
    """(key, line, parity, probe) of the different lines of a task; ``line`` is the line's hash."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        h = column(batch, "h").to_numpy()
        _, first = np.unique(h, return_index=True)
        first = first[~np.isin(h[first], seen)]
        if not len(first):
            continue
        seen = np.union1d(seen, h[first])
        lines = column(batch, "line").take(pa.array(first)).to_pylist()
        h = h[first]
        for a in range(0, len(lines), 4096):
            (key, which, probe), parity = keys_of(lines[a : a + 4096], most_edits, chars_per_edit)
            own = h[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[which]), pa.array(parity[which].view(np.int32)), pa.array(probe)], names=["key", "line", "parity", "probe"])


def close(p: np.ndarray, q: np.ndarray, most_edits: int) -> np.ndarray:
    """An edit changes the parity of two characters at most."""
    return np.bitwise_count(p ^ q) <= 2 * most_edits


def meetings(group, line, parity, probe, most_edits: int):
    """Index arrays of rows that share a group, one of them posting, and pass the parity test; rows of a group lie together."""
    at, step = np.arange(len(group)), 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        ok = at[close(parity[at], parity[at + step], most_edits) & ~(probe[at] & probe[at + step]) & (line[at] != line[at + step])]
        if len(ok):
            yield ok, ok + step
        step += 1


def long_meetings(key, line, parity, probe, most_edits: int):
    """The same for long groups. Parities that differ in 2 * most_edits bits agree in one of as many pieces and one more."""
    pieces = 2 * most_edits + 1
    edges = [32 * k // pieces for k in range(pieces + 1)]
    for a, b in zip(edges, edges[1:]):
        piece = (parity >> np.uint32(a)) & np.uint32((1 << (b - a)) - 1)
        order = np.lexsort((piece, key))
        group = np.cumsum(np.append(False, (key[order][1:] != key[order][:-1]) | (piece[order][1:] != piece[order][:-1])))
        for i, j in meetings(group, line[order], parity[order], probe[order], most_edits):
            yield order[i], order[j]


def runs(batches, columns: tuple[str, ...], most: int | None = None):
    """(crowded, arrays) of whole keys, from batches sorted by key; a row that repeats key, line and probe is left out.

    A key of more than ``most`` rows is not held: its rows come in parts, as crowded.
    """

    def once(now):
        key, line, _, probe = now[:4]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (line[1:] == line[:-1]) & (probe[1:] == probe[:-1])
        return tuple(x[~same] for x in now)

    held = crowded = None
    for batch in batches:
        now = tuple(column(batch, c).to_numpy(zero_copy_only=False) for c in columns)
        if crowded is not None:
            n = int(np.searchsorted(now[0], crowded, side="right"))
            if n:
                yield True, once(tuple(x[:n] for x in now))
            now = tuple(x[n:] for x in now)
        if not len(now[0]):
            continue
        crowded = None
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        n = int(np.searchsorted(now[0], now[0][-1]))
        if n:
            yield False, once(tuple(x[:n] for x in now))
        held = once(tuple(x[n:] for x in now))
        if most is not None and len(held[0]) > most:
            yield True, held
            held, crowded = None, held[0][0]
    if held is not None:
        yield False, held


def run_sizes(key: np.ndarray) -> np.ndarray:
    """For each row, the number of rows with its key."""
    size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
    return np.repeat(size, size)


MET = "key bigint, line bigint, parity int, probe boolean, other bigint"


def met(batches, most_edits: int, long_run: int):
    """What meets under a key: (line, other) for each pair of a short run; of a longer one its members, other null.

    Members are as many as there are, while pairs would grow with the square of a run. Those of a run
    that is not too long are only the ones that meet another.
    """
    for crowded, (key, line, parity, probe) in runs(batches, ("key", "line", "parity", "probe"), long_run):
        bits = parity.view(np.uint32)
        size = np.full(len(key), long_run + 1) if crowded else run_sizes(key)
        few = np.flatnonzero((size > 1) & (size <= SHORT_RUN))
        for i, j in meetings(key[few], line[few], bits[few], probe[few], most_edits):
            a, b = line[few[i]], line[few[j]]
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.minimum(a, b)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array(np.maximum(a, b))], names=["key", "line", "parity", "probe", "other"])
        many = np.flatnonzero((size > SHORT_RUN) & (size <= long_run))
        used = np.zeros(len(many), bool)
        for i, j in long_meetings(key[many], line[many], bits[many], probe[many], most_edits):
            used[i] = used[j] = True
        many = np.concatenate([many[used], np.flatnonzero(size > long_run)])
        if len(many):
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(line[many]), pa.array(parity[many]), pa.array(probe[many]), pa.nulls(len(many), pa.int64())], names=["key", "line", "parity", "probe", "other"])


def parity_parts(key: Column, parity: Column, most_edits: int) -> Column:
    """The keys under which the members of a crowded one meet again, one for each piece of the parity."""
    pieces = 2 * most_edits + 1
    edges = [32 * k // pieces for k in range(pieces + 1)]
    part = lambda k: F.shiftrightunsigned(parity, edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)
    return F.array(*(F.xxhash64(key, F.lit(k), part(k)) for k in range(pieces)))


def in_blocks(parts: DataFrame, long_part: int) -> DataFrame:
    """The members of parts with those of long ones in cells, one for each two blocks; ``block`` is -1 in a cell of one block.

    A member of a part of m blocks goes to m cells, each of which has the members of two blocks at most.
    """
    long = parts.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > long_part)
    long = stored(long.select("key", F.ceil(F.col("_n") / long_part).cast("int").alias("_m")))
    if long.isEmpty():
        return parts.withColumn("block", F.lit(-1))
    block = F.pmod(F.xxhash64("line"), F.col("_m")).cast("int")
    spread = parts.join(long, "key", "left").withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce("_m", F.lit(1)) - 1)))
    cell = F.xxhash64("key", F.least("_b", "_o"), F.greatest("_b", "_o"))
    return spread.select(F.when(F.col("_m").isNull(), F.col("key")).otherwise(cell).alias("key"), "line", "parity", "probe", F.when(F.col("_b") != F.col("_o"), F.col("_b")).otherwise(-1).alias("block"))


def verified_runs(batches, most_edits: int, chars_per_edit: int):
    """(a, b): the links among the members of parts of crowded keys, which come with their texts."""
    seen: set[tuple[int, int]] = set()
    for _, (key, line, parity, probe, block, text) in runs(batches, ("key", "line", "parity", "probe", "block", "text")):
        found = []
        for i, j in meetings(key, line, parity.view(np.uint32), probe, most_edits):
            apart = (block[i] < 0) | (block[i] != block[j])
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                pair = (int(min(line[x], line[y])), int(max(line[x], line[y])))
                if pair not in seen:
                    seen.add(pair)
                    if near(text[x], text[y], most_edits, chars_per_edit):
                        found.append(pair)
        if len(seen) > 1_000_000:
            seen.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])


def near(a: str, b: str, most_edits: int, chars_per_edit: int) -> bool:
    """Whether two lines are linked."""
    return within(a, b, min(most_edits, max(len(a), len(b)) // chars_per_edit))


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    Bit-parallel over the diagonals: bit d of row e says how far diagonal d is reached with e edits
    as a bit mask over the band of 2 * most + 1 diagonals around the main one, moved along with the
    text, so a step costs a few operations on small numbers however long the lines are.
    """
    if abs(len(a) - len(b)) > most:
        return False
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    while end > start and a[len(a) - 1 - (min(len(a), len(b)) - end)] == b[len(b) - 1 - (min(len(a), len(b)) - end)]:
        end -= 1
    cut = min(len(a), len(b)) - end
    a, b = a[start : len(a) - cut], b[start : len(b) - cut]
    if not a or not b:
        return len(a) + len(b) <= most
    width = 2 * most + 1
    full = (1 << width) - 1
    # rows[e]: bit d is set if the prefix of a read so far and the prefix of b that ends d - most later are within e edits.
    rows = [0] * (most + 1)
    for e in range(most + 1):
        rows[e] = sum(1 << (most + d) for d in range(min(e, len(b)) + 1))
    for i, c in enumerate(a):
        match = 0
        for d in range(width):
            j = i + d - most
            if 0 <= j < len(b) and b[j] == c:
                match |= 1 << d
        before = 0
        for e in range(most + 1):
            row = rows[e] & match
            if e:
                old = rows_old
                row |= old | (old >> 1) | (before << 1)
            rows_old, rows[e] = rows[e], row & full
            before = rows[e]
        if not rows[most]:
            return False
    return bool(rows[most] >> (most + len(b) - len(a)) & 1)


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def second_hash(line: Column) -> Column:
    """Another hash, of another seed, which tells lines apart whose first is the same."""
    return F.xxhash64(F.lit(1), line)


def not_blank(line: Column) -> Column:
    """Whether there is more than white space, of any alphabet: a lone carriage return is a blank line."""
    # Most lines show a printable ASCII character at once; the others are looked at for all alphabets.
    return line.rlike("[!-~]") | line.rlike(r"(?U)\S")


def split_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, line_no, line and h, its hash, for each line that isn't blank."""
    lines = docs.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(not_blank(F.col("line"))).withColumn("h", line_hash(F.col("line")))


def line_links(lines: DataFrame, most_edits: int = MOST_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(a, b): the hashes of each two different lines that are linked."""
    long_run, long_part = LONG_RUN, LONG_PART
    some = lines.where(F.char_length("line") >= chars_per_edit - 1).select("h", "line")
    posts = some.mapInArrow(lambda it: posted(it, most_edits, chars_per_edit), "key bigint, line bigint, parity int, probe boolean")
    sort = ("key", "line", "probe")
    meeting = stored(posts.repartition("key").sortWithinPartitions(*sort).mapInArrow(lambda it: met(it, most_edits, long_run), MET).distinct())
    needed = stored(meeting.select(F.explode(F.array_compact(F.array("line", "other"))).alias("h")).distinct())
    if needed.count() <= MOST_BROADCAST:
        needed = F.broadcast(needed)
    texts = some.join(needed, "h", "left_semi").groupBy("h").agg(F.first("line").alias("text"))

    def verify(batches):
        for batch in batches:
            ok = [near(x, y, most_edits, chars_per_edit) for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = meeting.where("other IS NOT NULL").select(F.col("line").alias("a"), F.col("other").alias("b"))
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b")
    members = meeting.where("other IS NULL").select(F.explode(parity_parts(F.col("key"), F.col("parity"), most_edits)).alias("key"), "line", "parity", "probe")
    parts = in_blocks(members, long_part).join(texts.withColumnRenamed("h", "line"), "line")
    linked = both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")
    linked = linked.unionByName(parts.repartition("key").sortWithinPartitions(*sort).mapInArrow(lambda it: verified_runs(it, most_edits, chars_per_edit), "a bigint, b bigint"))
    return stored(linked.distinct())


def line_classes(lines: DataFrame, most_edits: int = MOST_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """The lines, and (h, n_copies, n_links, first) of each different one; ``first`` names its class: (no_id, doc_id, line_no).

    Different lines with one ``h`` show by their second hash and get that as their ``h``; both hashes
    are the same for one in 2^128 pairs.
    """
    place, second = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no"), second_hash(F.col("line"))

    def counted(lines: DataFrame) -> DataFrame:
        return stored(lines.groupBy("h").agg(F.min(place).alias("own"), F.count("*").alias("n_copies"), F.min(second).alias("_a"), F.max(second).alias("_b")))

    own = counted(lines)
    shared = own.where("_a <> _b").select("h", F.lit(True).alias("_shared"))
    if not shared.isEmpty():
        lines = lines.join(shared, "h", "left").withColumn("h", F.when(F.col("_shared"), second).otherwise(F.col("h"))).drop("_shared")
        own = counted(lines)
    own = own.drop("_a", "_b")
    links = line_links(lines, most_edits, chars_per_edit)
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("n_links"))
    rooted = own.join(degree, "h", "left").join(components(links).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    rooted = stored(rooted)
    named = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return lines, rooted.join(named, "root").select("h", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first")


def classify_lines(docs: DataFrame) -> DataFrame:
    """Each line that isn't blank: doc_id, line_no, n_links (different lines it is linked to) and the place of its class's first line."""
    lines, classes = line_classes(split_lines(docs))
    return lines.select("doc_id", "line_no", "h").join(classes, "h").select("doc_id", "line_no", "n_links", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"))


def without_repeated_lines(docs: DataFrame, keep: tuple[str, ...], of_files: bool = False) -> DataFrame:
    """The documents without the lines of which an earlier document, or an earlier place, has one of the same class.

    ``text`` is what is left and ``n_chars``, if kept, its length; a document all of whose lines are
    repeats goes, one without any line (null or blank) stays as it is. ``of_files``: see ``numbered``.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    tagged = numbered(docs, of_files).select(*keep, "_row")
    lines, classes = line_classes(split_lines(tagged, ("_row", "doc_id")))
    repeats = lines.select("_row", "doc_id", "line_no", "h").join(classes, "h").where(place != F.col("first"))
    gone = repeats.groupBy("_row").agg(F.collect_set("line_no").alias("_gone"))

    def cut(batches):
        for batch in slices(batches, most=1 << 20):
            texts = column(batch, "text").to_pylist()
            for i, numbers in enumerate(column(batch, "_gone").to_pylist()):
                if numbers:
                    lines = texts[i].split("\n")
                    left = np.ones(len(lines), bool)
                    left[numbers] = False
                    texts[i] = "\n".join(compress(lines, left.tolist()))
            kept = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([kept if name == "_kept" else column(batch, name) for name in (*wanted, "_kept")], names=[*wanted, "_kept"])

    joined = tagged.join(gone, "_row", "left").withColumn("_some", F.col("_gone").isNotNull())
    wanted = [*(c for c in keep if c != "text"), "_some"]
    types = dict(joined.dtypes)
    out = joined.select(*wanted, "text", "_gone").mapInArrow(cut, ", ".join([*(f"`{c}` {types[c]}" for c in wanted), "_kept string"]))
    out = out.where(~F.col("_some") | not_blank(F.col("_kept")))
    new = {"text": F.col("_kept"), "n_chars": F.when(F.col("_kept").isNotNull(), F.char_length("_kept")).cast("bigint")}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in keep))
