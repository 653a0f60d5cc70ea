"""The pipeline against five slow stages over a small table."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lacre.llm import langid, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
        row = new
    return row[-1]


def classes(n, linked):
    """The least member of each one's component."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def languages(rows):
    """Whole texts, a language by the plain sum over its words with the model's own scores."""
    train = [(r[2], r[1]) for r in rows if r[2] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    counts = collections.Counter()
    for lang, text in train:
        for _, piece in langid.cut(text or ""):
            _, bucket, script, *_ = langid.trigrams(piece)
            counts.update((lang, int(b)) for b in bucket)
            counts.update((lang, langid.BUCKETS + int(s)) for s in script)
    model = langid.Model([(lang, b, n) for (lang, b), n in counts.items()])
    kept = []
    for r in rows:
        lang, score, _ = langid.label_texts(model, [r[1] or ""], langid.SWITCH_PENALTY)[0]
        if lang != "und" and score >= 0.5:
            kept.append(r)
    return kept


def lines(rows):
    places = [(r[0], n, line, k) for k, r in enumerate(rows) if r[1] is not None for n, line in enumerate(r[1].split("\n")) if line.strip(" ")]
    texts = sorted({p[2] for p in places})
    of = dict(zip(texts, classes(len(texts), lambda i, j: edits(texts[i], texts[j]) <= min(2, max(len(texts[i]), len(texts[j])) // 5))))
    first = {}
    for doc, n, line, _ in places:
        place = (doc is None, doc or 0, n)
        first[of[line]] = min(first.get(of[line], place), place)
    gone = {(k, n) for doc, n, line, k in places if (doc is None, doc or 0, n) != first[of[line]]}
    kept = []
    for k, r in enumerate(rows):
        if r[1] is None:
            kept.append(r)
            continue
        left = [line for n, line in enumerate(r[1].split("\n")) if (k, n) not in gone]
        cut = len(left) < len(r[1].split("\n"))
        text = "\n".join(left)
        if not cut or text.replace("\n", " ").strip(" "):
            kept.append((r[0], text, r[2], r[3], len(text)))
    return kept


def fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def near_copies(rows):
    marks = [fingerprint(r[1]) for r in rows]
    groups = collections.defaultdict(list)
    for r, root in zip(rows, classes(len(rows), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)):
        groups[root].append(r)
    return groups


def benchmarks(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + min(13, len(w))]) for w in map(low, items) if w for i in range(len(w) - min(13, len(w)) + 1)}
    kept = []
    for r in rows:
        words, hit = low(r[1]), set()
        for w in windows:
            for j in range(len(words) - len(w) + 1):
                if tuple(words[j : j + len(w)]) == w:
                    hit |= set(range(j, j + len(w)))
        if not (hit and 20 * len(hit) >= len(words)):
            kept.append(r)
    return kept


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(4)

    def sentence(n, vowels):
        return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(n))

    share, passage = "see the terms of use of this site", sentence(15, "aeiou")
    rows = []
    for i in range(70):
        vowels = "aeiou" if i % 2 else "éàüo"
        text = "\n".join(sentence(rng.randint(3, 14), vowels) for _ in range(rng.randint(1, 5)))
        rows.append([i, text, "xx" if i % 2 else "yy", f"s{i % 3}", len(text)])
    for i in (3, 9, 15):
        rows[i][1] += "\n" + share.replace("use", "us" if i == 9 else "use")
    rows[20][1] = passage
    rows[21][1] = sentence(400, "aeiou") + " " + passage
    rows += [[100, rows[5][1], "xx", "s0", 1], [101, rows[7][1].replace("\n", " "), "xx", "s1", 1], [102, None, None, None, None], [103, "", "xx", "s0", 0], [104, "12 34\n--", "yy", "s1", 8], [None, sentence(30, "aeiou"), None, None, None], [None, sentence(30, "éàüo"), "yy", "s2", 1]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "of the")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [tuple(r) for r in rows], [passage]


def test_stages_are_the_slow_ones(spark, made, tmp_path):
    folder, rows, items = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    for k, (name, slow) in enumerate((("language ID", languages), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", lambda r: benchmarks(r, items)))):
        stages[name](spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == list(COLUMNS)
        got, want = sorted((tuple(r) for r in docs.collect()), key=key), slow(rows)
        if name == "SimHash near-dedup":
            assert len(got) == len(want) < len(rows)
            for group in want.values():
                (kept,) = [r for r in got if r in group]
                assert kept[0] == min((r[0] for r in group if r[0] is not None), default=None)
            rows = got
            continue
        rows = sorted(want, key=key)
        assert got == rows, name
    assert 20 not in {r[0] for r in rows} and 21 in {r[0] for r in rows}
    tokenizer = packing.word_ids(packing.TOKENIZER).tokenizer
    ids = {key(r): [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces = stages["packing"](spark, docs, folder).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values())) and set(by_doc) == {r[0] for r in rows}
    for r in rows:
        if r[0] is not None:
            own = sorted(by_doc[r[0]], key=lambda p: p.start)
            assert [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()] == ids[key(r)]
            assert all(p.ids_crc32 == zlib.crc32(p.ids) for p in own)


def test_run_applies_all_stages(spark, made):
    folder, _, _ = made
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "ids_crc32"} == set(out.columns) and out.count() > 0
