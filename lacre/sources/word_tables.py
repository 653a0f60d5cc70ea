"""Pages from word tables, as a data source that splits a file by its pages.

A word table is what OCR engines write as TSV: a header, then a row for each level of a page's
structure, the words among them, with pages in rising order. A file of up to ``split_bytes`` is one
partition; a longer one is cut into ranges of pages, and a task finds the place at which its range
begins by halving the file, so it reads little beyond its own pages. The option ``pages`` names the
pages to read, such as ``0-2,7,30-``: ranges without them have no partition, and other pages' rows
are not parsed. It is an option, not a filter pushed down, as Spark 4.1 keeps what the first filter
of a DataFrame left of a Python source for all later queries of it. Files are opened by pyarrow,
wherever its file systems reach.

    register(spark)
    spark.read.format("word_tables").option("pages", "0-2").load(folder)

Defined results: an empty file, and one with a header alone, give no rows; a row with missing fields,
or a page that comes before the one above it, is an error that names the file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: The columns of the format, in their order.
FORMAT = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
SCHEMA = "doc_id string, page int, idx bigint, level int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
ARROW = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("idx", pa.int64()), *((c, pa.int32()) for c in ("level", *FORMAT[2:6])), *((c, pa.float64()) for c in FORMAT[6:11]), ("text", pa.string())])
SPLIT_BYTES = 32 << 20
BATCH_ROWS = 8192
MOST_LINE = 1 << 16
NEVER = 2**31 - 1


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def page_of(line: bytes, path: str) -> int:
    fields = line.split(b"\t", 2)
    if len(fields) < 3 or not fields[1].strip().isdigit():
        raise ValueError(f"{path}: not a row of a word table: {line[:80]!r}")
    return int(fields[1])


def lines_from(file: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at ``at`` or later."""
    rest, begin = b"", at
    while at < size:
        data = file.read_at(min(1 << 20, size - at), at)
        at += len(data)
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield begin, line
            begin += len(line) + 1
    if rest:
        yield begin, rest


def header_size(file: pa.NativeFile, path: str, size: int) -> int:
    head = file.read_at(min(size, 1024), 0).split(b"\n", 1)
    if size and tuple(head[0].decode().rstrip("\r").split("\t")) != FORMAT:
        raise ValueError(f"{path}: the header of a word table is missing")
    return min(size, len(head[0]) + 1)


def place_of(file: pa.NativeFile, path: str, page: int, begin: int, size: int) -> int:
    """The offset of the first line of ``page`` or a later one."""
    low, high = begin, size
    while high - low > MOST_LINE:
        middle = (low + high) // 2
        # The first whole line behind the middle; a line is looked for as far as the part in question goes.
        found = next(((at, line) for k, (at, line) in enumerate(lines_from(file, middle, size)) if k and line.strip()), None)
        if found is None or found[0] >= high or page_of(found[1], path) >= page:
            high = middle
        else:
            low = found[0]
    for at, line in lines_from(file, low, size):
        if line.strip() and page_of(line, path) >= page:
            return at
    return size


def last_page(file: pa.NativeFile, path: str, begin: int, size: int) -> int:
    reach = 1 << 16
    while True:
        at = max(begin, size - reach)
        tail = [line for k, (_, line) in enumerate(lines_from(file, at, size)) if line.strip() and (k or at == begin)]
        if tail or at == begin:
            return page_of(tail[-1], path) if tail else -1
        reach *= 4


def page_ranges(text: str) -> list[tuple[int, int]]:
    """(first, end) of each part of ``text``: a page, ``a-b`` with both, or ``a-`` for all from a on."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        first, dash, last = part.partition("-")
        out.append((int(first), (int(last) + 1 if last else NEVER) if dash else int(first) + 1))
    return out


class WordTableReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("word_tables reads a path")
        self.path, self.split_bytes = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.ranges = page_ranges(options.get("pages", "0-"))

    def files(self) -> Iterator[tuple[str, int]]:
        system, path = opened(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        for info in sorted(listed, key=lambda x: x.path):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                yield prefix + info.path, info.size

    def wanted(self, page: int) -> bool:
        return any(a <= page < b for a, b in self.ranges)

    def partitions(self) -> list[PageRange]:
        out = []
        least, end = min((a for a, _ in self.ranges), default=0), max((b for _, b in self.ranges), default=0)
        for path, size in self.files():
            if not size or least >= end:
                continue
            if size <= self.split_bytes:
                out.append(PageRange(path, least, end))
                continue
            system, name = opened(path)
            with system.open_input_file(name) as file:
                begin = header_size(file, path, size)
                pages = last_page(file, path, begin, size) + 1
            step = max(1, math.ceil(pages / math.ceil(size / self.split_bytes)))
            for first in range(0, pages, step):
                own = [(max(first, a), min(first + step, b)) for a, b in self.ranges]
                own = [(a, b) for a, b in own if a < b]
                if own:
                    out.append(PageRange(path, min(a for a, _ in own), max(b for _, b in own)))
        return out

    def read(self, partition: PageRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no partition
            return
        system, name = opened(partition.path)
        with system.open_input_file(name) as file:
            size = file.size()
            begin = header_size(file, partition.path, size)
            if partition.first:
                begin = place_of(file, partition.path, partition.first, begin, size)
            page, idx, rows = -1, 0, []
            for _, line in lines_from(file, begin, size):
                if not line.strip():
                    continue
                own = page_of(line, partition.path)
                if own < page:
                    raise ValueError(f"{partition.path}: page {own} comes after page {page}")
                if own >= partition.end:
                    break
                page, idx = own, idx + 1 if own == page else 0
                if not self.wanted(own):
                    continue
                fields = line.decode().rstrip("\r").split("\t", len(FORMAT) - 1)
                if len(fields) != len(FORMAT):
                    raise ValueError(f"{partition.path}: a row of {len(fields)} fields on page {own}")
                rows.append((partition.path, own, idx, int(fields[0]), *map(int, fields[2:6]), *map(float, fields[6:11]), fields[11]))
                if len(rows) == BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class WordTables(DataSource):
    """``spark.read.format("word_tables")``: doc_id (the path), page, idx (the row's place on its page) and the format's columns."""

    @classmethod
    def name(cls) -> str:
        return "word_tables"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WordTableReader:
        return WordTableReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(WordTables)
