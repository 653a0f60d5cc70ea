"""Word tables: split by pages, and only the pages asked for."""

import random

import pytest

from lacre.operators import layout
from lacre.sources import word_tables

HEADER = "\t".join(word_tables.FORMAT)


def written(path, pages, words, newline="\n"):
    """A table of pages with ``words`` words each, and its rows."""
    rng = random.Random(len(pages))
    lines, rows = [HEADER], []
    for page in pages:
        for i in range(words):
            text = rng.choice(["", "palavra", "ação", "x\ty"]) if i else ""
            own = (5 if i else 1, 1, 1, i // 4, i % 4, float(i), 2.0, 3.0, 4.5, -1.0 if not text else 90.5, text)
            lines.append("\t".join(map(str, (own[0], page, *own[1:]))))
            rows.append((str(path), page, i, *own))
    path.write_text(newline.join(lines) + newline)
    return rows


@pytest.fixture
def folder(tmp_path):
    written(tmp_path / "empty.tsv", [], 0)
    (tmp_path / "nothing.tsv").write_text("")
    (tmp_path / "_SUCCESS").write_text("x")
    return tmp_path, written(tmp_path / "a.tsv", range(40), 9) + written(tmp_path / "b.tsv", [1, 2, 7, *range(9, 60, 2)], 5, "\r\n")


def reader(spark, split_bytes):
    word_tables.register(spark)
    return spark.read.format("word_tables").option("split_bytes", split_bytes)


@pytest.mark.parametrize("split_bytes", [1 << 20, 4000, 300, 1])
def test_every_row_once(spark, folder, split_bytes):
    path, rows = folder
    found = reader(spark, split_bytes).load(str(path))
    assert sorted(tuple(r) for r in found.collect()) == sorted(rows)
    for pages, keeps in {"7": lambda p: p == 7, "3,39,41,1000": lambda p: p in (3, 39, 41), "6-11": lambda p: 5 < p <= 11, "0-1, 59-": lambda p: p < 2 or p >= 59, "": lambda p: False, "50": lambda p: False}.items():
        own = reader(spark, split_bytes).option("pages", pages).load(str(path))
        assert sorted(tuple(r) for r in own.collect()) == sorted(r for r in rows if keeps(r[1])), pages
        assert own.where("page > 6").count() == len([r for r in rows if keeps(r[1]) and r[1] > 6]) and own.count() == len([r for r in rows if keeps(r[1])])


def test_two_files_in_four_partitions_and_only_the_pages_asked_for(folder):
    path, rows = folder
    size = {n: (path / n).stat().st_size for n in ("a.tsv", "b.tsv")}
    source = word_tables.WordTableReader({"path": str(path), "split_bytes": str(max(size.values()) // 2 + 1)})
    parts = source.partitions()
    big = [p for p in parts if p.path.endswith("a.tsv")]
    assert [(p.first, p.end) for p in big] == [(0, 20), (20, 40)]
    halves = word_tables.WordTableReader({"path": str(path), "split_bytes": str(min(size.values()) // 2 + 1)})
    assert len([p for p in halves.partitions() if p.path.endswith("b.tsv")]) == 2
    asked = word_tables.WordTableReader({"path": str(path), "split_bytes": str(size["a.tsv"] // 4), "pages": "12-13"})
    parts = asked.partitions()
    assert [(p.first, p.end) for p in parts if p.path.endswith("a.tsv")] == [(12, 14)]
    found = [r for p in parts for b in asked.read(p) for r in b.to_pylist()]
    assert {(r["doc_id"][-5:], r["page"]) for r in found} == {("a.tsv", 12), ("a.tsv", 13), ("b.tsv", 13)}
    assert len(found) == len([r for r in rows if 12 <= r[1] < 14])


def test_a_task_reads_little_beyond_its_pages(tmp_path):
    written(tmp_path / "long.tsv", range(3000), 40)
    size = (tmp_path / "long.tsv").stat().st_size
    file = word_tables.opened(str(tmp_path / "long.tsv"))[0].open_input_file(str(tmp_path / "long.tsv"))
    begin = word_tables.header_size(file, "long", size)
    assert word_tables.last_page(file, "long", begin, size) == 2999
    data = (tmp_path / "long.tsv").read_bytes()
    for page in (0, 1, 1500, 2999):
        assert word_tables.place_of(file, "long", page, begin, size) == data.index(f"\n1\t{page}\t".encode()) + 1
    assert word_tables.place_of(file, "long", 3000, begin, size) == size


@pytest.mark.parametrize("lines", [["no header"], [HEADER, "1\t2\t3"], [HEADER, "\t".join("5" * 12), "\t".join(["5", "4", *"5" * 10])], [HEADER, "words"]])
def test_a_broken_table_is_an_error(spark, tmp_path, lines):
    (tmp_path / "x.tsv").write_text("\n".join(lines))
    with pytest.raises(Exception, match="x.tsv"):
        reader(spark, 1 << 20).load(str(tmp_path)).collect()


def test_no_such_folder(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        reader(spark, 1 << 20).load(f"{tmp_path}/nowhere").collect()


def test_pages_become_text(spark, tmp_path):
    rows = [HEADER, *("\t".join(map(str, r)) for r in [(1, 1, 0, 0, 0, 0, 0, 0, 50, 50, -1, ""), (5, 1, 1, 1, 1, 1, 0, 0, 5, 5, 95.5, "um"), (5, 1, 1, 1, 1, 2, 6, 0, 5, 5, 40, "dois"), (5, 1, 1, 1, 2, 1, 0, 9, 5, 5, 80, "três")])]
    (tmp_path / "p.tsv").write_text("\n".join(rows))
    pages = layout.pages_of_words(reader(spark, 10).load(str(tmp_path)))
    assert layout.page_texts(pages).first()["text"] == "um dois\ntrês"
    assert [(r["text"], r["start"], r["end"]) for r in layout.low_confidence(pages).collect()] == [("dois", 3, 7)]
