"""The operators that compare rows: packing, line dedup, top-k, SimHash, substrings, and the pipeline."""

import collections
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lacre.llm import graph, linedup, packing, simhash, substrings, topk

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def merged(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(50, i) for i in range(51, 90)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(3, 3)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame([*links, (None, 4)], "a bigint, b bigint")).collect()}
    want = merged(200, links)
    assert {i: r for i, r in enumerate(want) if r != i} == found
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(text):
    words = BLANKS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


@pytest.mark.parametrize("most_list", [simhash.MOST_LIST, 1])
def test_simhash_is_brute_force(documents, nothing, most_list):
    found = simhash.near_duplicates(documents, ("doc_id", "text"), most_list).collect()
    assert len(found) == documents.count()
    marks = [brute_fingerprint(r.text) for r in found]
    assert all((r.fp & (1 << 64) - 1) == m for r, m in zip(found, marks))
    links = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4]
    groups = collections.defaultdict(list)
    for i, root in enumerate(merged(len(marks), links)):
        groups[root].append(found[i])
    for rows in groups.values():
        assert {r.component_id for r in rows} == {min((r.doc_id for r in rows if r.doc_id is not None), default=None)}
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("long_list", [2, 48])
def test_links_span_the_components(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            x = center
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    posts = [b for b in simhash.posted([__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(signed)], names=["fp"])], 3)]
    table = __import__("pyarrow").Table.from_batches(posts).sort_by("key")
    at = {x: i for i, x in enumerate(signed)}
    links = [(at[a], at[b]) for t in simhash.links_of(iter(table.to_batches(max_chunksize=333)), 1 << 40) for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist())]
    all_links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert set(map(frozenset, links)) <= set(map(frozenset, all_links))
    assert merged(len(fps), links) == merged(len(fps), all_links)


def test_near_unique_keeps_one_of_each(documents):
    keep = ("doc_id", "text", "lang", "source", "n_chars")
    kept = simhash.near_unique(documents, keep)
    groups = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert kept.count() == len(groups) and kept.columns == list(keep)
    assert {r.doc_id for r in kept.collect()} == groups


def test_near_unique_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d = ("".join(rng.choice("bcdfgklm aeiou") for _ in range(600)) for _ in range(4))
    docs = spark.createDataFrame([(None, a), (None, b), (None, b), (7, c), (7, d), (8, d)], "doc_id bigint, text string")
    kept = sorted(map(tuple, simhash.near_unique(docs, ("doc_id", "text")).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)


def brute_repeats(texts, window=35):
    words = [BLANKS.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("batch", [8 << 20, 2000])
def test_substrings_are_brute_force(documents, nothing, monkeypatch, batch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    monkeypatch.setattr(substrings, "RANGE_BYTES", batch)
    found = substrings.remove_repeats(documents, ("doc_id", "text")).collect()
    assert len(found) == documents.count() and sum(r.n_removed for r in found) > 200
    for r, (n, gone, kept) in zip(found, brute_repeats([r.text for r in found])):
        assert (r.n_words, r.n_removed, r.kept) == (n, gone, kept)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert substrings.remove_repeats(nothing).count() == 0


def test_colliding_hashes_remove_nothing(documents, monkeypatch):
    """All windows have one hash, so only their words tell them apart."""
    monkeypatch.setattr(substrings, "word_hashes", lambda text: np.zeros(len(text.split()), np.uint64))
    texts = [r.text for r in documents.select("text").collect()]
    batch = substrings.Batch([(t or "").encode() for t in texts], 35)
    at = np.flatnonzero(batch.fits_window)
    assert len(set(batch.windows(at).tolist())) == 1 and len(set(batch.digests(at).tolist())) > 100
    known = substrings.lists(0, batch.windows(at), batch.digests(at), np.full(len(at), 2, np.uint8), 64, 1)
    found = substrings.shared(known)
    gone = substrings.covered(batch, at[substrings.among(batch.windows(at), batch.digests(at), *substrings.listed(found))])
    counts = [int(gone[a:b].sum()) for a, b in zip(batch.bounds, batch.bounds[1:])]
    assert counts == [n for _, n, _ in brute_repeats(texts)] and sum(counts) > 200


def test_repeats_within_one_text(spark):
    a = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a + " x " + a), (2, "a " * 40), (3, "b " * 35), (4, "é\x0b" * 34 + "é")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 100, 2: 40, 3: 0, 4: 0}


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = " ".join("x" * (i % 40) for i in range(4000)).encode()
    whole = substrings.hashed([text])[0]
    monkeypatch.setattr(substrings, "PIECE", 1000)
    assert np.array_equal(whole, substrings.hashed([text])[0]) and len(whole) == len(text.split())


def test_packing_keeps_every_token(documents, nothing):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    tokenizer = Tokenizer.from_file(public.path(packing.TOKENIZER))
    found = packing.pack(documents, ("doc_id", "text"), sequence=64, window=256, shard_tokens=3000).collect()
    by_text = collections.defaultdict(list)
    for r in found:
        by_text[(r.doc_id, r.text)].append(r)
    for (_, text), pieces in by_text.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        cover = collections.Counter()
        for p in pieces:
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids)
            cover.update(range(p.start, p.start + p.length))
        assert set(cover) == set(range(len(ids))) and len(set(cover.values())) == 1
    places = sorted((r.sequence_id * 64 + r.offset, r.length) for r in found)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert all(r.offset + r.length <= 64 for r in found)
    assert packing.pack(nothing).count() == 0


def test_ids_that_are_texts(spark):
    rows = [("", "some words"), ("b", "more words"), (None, "words"), ("a", ""), (None, "of none"), ("", "some words")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id string, text string, source string")
    found = packing.pack(docs).collect()
    assert collections.Counter(r["doc_id"] for r in found if r["start"] == 0) == collections.Counter(i for i, _ in rows)


def test_words_alone_give_the_ids_of_texts():
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    tokenizer = Tokenizer.from_file(public.path(packing.TOKENIZER))
    ids = packing.WordIds(packing.TOKENIZER)
    texts = ["Hello, World. it's  don't\n\tÉté STRASSE straße İstanbul Σίσυφος", "a.b, c.. <|endoftext|> <|ENDOFTEXT|>. x", "١٢ 12th éte   nbsp em", "日本語 text, é. ÀÖ.,", "", " ", "\r\nline"]
    for t, b in zip(texts, ids.texts(texts, 1)):
        assert np.frombuffer(b, ids.kind).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_windows_have_the_target_mixture():
    queued, share = np.array([5000, 3000, 2000]), np.array([0.5, 0.3, 0.2])
    order = packing.served(queued, share, np.zeros(3), 0, 1000)
    at, window = 0, np.zeros((10, 3))
    for s, n in order:
        while n:
            m = min(n, 1000 - at % 1000)
            window[at // 1000, s] += m
            at, n = at + m, n - m
    assert np.abs(window / 1000 - share).max() < 0.01
    late = packing.served(np.array([100, 900]), share[:2], np.array([-400.0, 400.0]), 500, 1000)
    assert late[0][0] == 1 and sum(n for _, n in late) == 1000


def test_targets_shape_the_stream(documents):
    found = packing.pack(documents.where("text is not null"), ("doc_id", "source"), targets={"src0": 3, "src1": 1}, sequence=64, window=256)
    first = collections.Counter()
    for r in found.where("sequence_id < 16").collect():
        first[r.source] += r.length
    assert abs(first["src0"] / (first["src0"] + first["src1"]) - 0.75) < 0.05


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
        row = new
    return row[-1]


def altered(rng, line, n):
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        line = rng.choice([line[:i] + rng.choice("abé") + line[i:], line[:i] + line[i + 1 :], line[:i] + rng.choice("abé") + line[i + 1 :]])
    return line


@pytest.mark.parametrize("most_edits", [1, 2, 3])
def test_banded_distance(most_edits):
    rng = random.Random(most_edits)
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = altered(rng, a, rng.randint(0, most_edits + 2))
        assert linedup.within(a, b, most_edits) == (edits(a, b) <= most_edits)


@pytest.mark.parametrize("broadcast,long_run,long_part,least", [(0, 4096, 50_000, 20), (1 << 20, 2, 3, 20), (1 << 20, 4096, 50_000, 3), (1 << 20, 1, 50_000, 3)])
def test_line_links_are_brute_force(spark, monkeypatch, broadcast, long_run, long_part, least):
    monkeypatch.setattr(linedup, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(linedup, "LONG_RUN", long_run)
    monkeypatch.setattr(linedup, "LONG_PART", long_part)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(least, 50 if least > 3 else 16))) for _ in range(25)]
    texts = list({x.strip() for b in base[:20] for x in [b, *(altered(rng, b, rng.randint(1, 4)) for _ in range(4))]} | {altered(rng, base[24], rng.randint(0, 2)) for _ in range(40)})
    texts = [t for t in texts if t.strip()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])], "doc_id bigint, text string")
    lines = linedup.split_lines(docs)
    text_of = {r.h: r.line for r in lines.collect()}
    got = {frozenset((text_of[r.a], text_of[r.b])) for r in linedup.line_links(lines).collect()}
    want = {frozenset((a, b)) for a in texts for b in texts if a < b and edits(a, b) <= min(2, max(len(a), len(b)) // 5)}
    assert got == want and len(want) > 20
    classes = {(r.doc_id, r.line_no): r for r in linedup.classify_lines(docs).collect()}
    roots = merged(len(texts), [tuple(texts.index(x) for x in pair) for pair in want])
    for i in range(len(texts)):
        assert classes[i, 0].class_doc_id == roots[i] and classes[i, 0].n_links == sum(texts[i] in p for p in want)
        if i < 9:
            assert classes[len(texts) + i, 0].class_doc_id == roots[i]


def test_a_crowded_key_comes_in_parts():
    rows = [(1, 5), (2, 1), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 5), (3, 7), (3, 8), (4, 1)]
    table = pa.table({"key": [k for k, _ in rows], "line": [x for _, x in rows], "parity": [0] * len(rows), "probe": [False] * len(rows)})
    for size in (1, 2, 3, 20):
        found = [(crowded, list(zip(key.tolist(), line.tolist()))) for crowded, (key, line, _, _) in linedup.runs(table.to_batches(max_chunksize=size), ("key", "line", "parity", "probe"), 2)]
        assert sorted({x for _, part in found for x in part}) == sorted(set(rows))
        assert all(len({k for k, _ in part}) == 1 for crowded, part in found if crowded)
        assert {k for crowded, part in found if crowded for k, _ in part} <= {2}
        held = [k for crowded, part in found if not crowded for k in {k for k, _ in part}]
        assert len(held) == len(set(held))


@pytest.mark.parametrize("of_files", [False, True])
def test_rows_are_told_apart_by_number(spark, tmp_path, of_files):
    path = str(tmp_path / "docs")
    text = "a line that is long enough to be compared\nwords of one"
    spark.createDataFrame([(1, text), (2, text.replace("one", "two hundred")), (None, text), (None, "other words")], "doc_id bigint, text string").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    found = sorted((r.doc_id or 0, r.text) for r in linedup.without_repeated_lines(docs, ("doc_id", "text"), of_files=of_files).collect())
    assert found == [(0, "other words"), (1, text), (2, "words of two hundred")]
    made = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    assert sorted(r.text for r in linedup.without_repeated_lines(made, ("doc_id", "text")).collect()) == sorted(["other words", *text.split("\n"), "words of two hundred"])


def test_repeated_lines_go(spark, documents, nothing):
    keep = ("doc_id", "text", "lang", "source", "n_chars")
    line = "a line that is long enough to be compared"
    rows = [(1, f"{line}\n\nshort\nown words of one"), (2, f"own words of two\n{line.replace('long', 'lung')}\n \nshort"), (3, line), (4, None), (5, ""), (None, line + "\nlast"), (6, f"{line}\n{line}")]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r.doc_id: r.text for r in linedup.without_repeated_lines(docs, keep).collect()}
    assert found == {1: rows[0][1], 2: "own words of two\n ", 4: None, 5: "", None: "last"}
    assert linedup.without_repeated_lines(nothing, keep).count() == 0
    out = linedup.without_repeated_lines(documents, keep)
    assert out.columns == list(keep) and all(r.text is None or r.n_chars is None or r.n_chars == len(r.text) or r.doc_id == 200 for r in out.collect())


def test_paragraph_breaks_with_carriage_returns_stay(spark):
    rows = [(1, "first words of one\r\n\r\nmore words of one\r\n\u2003\r\nend of one"), (2, "a second text\r\n\r\n\r\nwith other words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in linedup.without_repeated_lines(docs, ("doc_id", "text")).collect()} == dict(rows)


def test_lines_whose_hashes_meet_stay(spark, monkeypatch):
    monkeypatch.setattr(linedup, "line_hash", lambda line: F.xxhash64(F.substring(line, 1, 3)))
    rows = [(1, "abc one line of words\nabc quite another, longer"), (2, "abc a third of them\nabc one line of words"), (3, "xyz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in linedup.without_repeated_lines(docs, ("doc_id", "text")).collect()}
    assert found == {1: rows[0][1], 2: "abc a third of them", 3: "xyz"}
    links = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in linedup.classify_lines(docs).collect()}
    assert links == {(1, 0): (1, 0), (1, 1): (1, 1), (2, 0): (2, 0), (2, 1): (1, 0), (3, 0): (3, 0)}


def test_a_text_of_very_many_lines(spark):
    rows = [(1, "the same line once more\n" * 400_000 + "end"), (2, "end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in linedup.without_repeated_lines(docs, ("doc_id", "text")).collect()} == {1: "the same line once more\nend"}


def brute_top_k(rows, k=20):
    usable = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in usable if i % 20 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"node_rows": 40, "page_rows": 4, "block_rows": 3, "most_roots": 3}])
def test_top_k_is_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (0.2 + i % 3)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 360)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, rows[0][1]), (404, [1.0]), (420, []), rows[7], rows[20]]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, v int")
    found = [tuple(r) for r in topk.top_k(table, **sizes).collect()]
    assert set(found) == brute_top_k(rows)
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.top_k(table.where("vec_id = 20").distinct()).count() == 0


def test_pipeline(spark, documents, benchmark, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    documents.select(columns).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            assert 0 < docs.count() <= before.count()
    tokens = {r[0] for r in before.select("doc_id").collect()}
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == tokens
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    kept = lambda: {p.name for p in Path(folder.removeprefix("file:")).glob("pipeline-*")}
    before = kept()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert [name[-2:] for name in kept() - before] == ["-4"]
