"""Operator 8: language identification of mixed-language text.

A model of hashed letter trigrams and of the scripts of each language is counted over the whole text
of every labelled training document. In a document each run of letters of one script, with their marks, is a word; its
script narrows the languages that may have written it, and each of these gives it the sum of its
trigrams' log probabilities. A Viterbi pass over the words, with a penalty for each switch, labels
them; neighbouring words of one label are a span. The document's language is that of most letters.

Defined results: a null or empty text, or one without letters, is ``und`` with score 0 and no spans;
a script that no learned language uses leaves all languages open; with no training rows at all every
document is ``und``; ties between languages go to the first in alphabetical order. A null doc_id is
neither held out nor learned from. Rows that are repeated are counted and labelled each time.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column, id_remainder, schema_with, slices

BUCKETS = 1 << 16
SWITCH_PENALTY = 10.0
PIECE = 1 << 20
RESULT = "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

#: First code points of script ranges. What lies before the first or between named ones is "other".
SCRIPTS = (
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x750, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"),
    (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "hiragana"), (0x30A0, "katakana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x323B0, "other"),
)
NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: number of its script from 1, 0 where it is neither letter nor mark; its lower case; whether it is a letter."""
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    firsts = np.array([a for a, _ in SCRIPTS])
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if kind in "LM":
            k = int(np.searchsorted(firsts, c, side="right")) - 1
            script[c] = NAMES.index(SCRIPTS[k][1] if k >= 0 else "other") + 1
            letter[c] = kind == "L"
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return script, lower, letter


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters and marks; the bucket of the trigram around each; its script; whether it begins a word; whether it is a letter."""
    script_of, lower, letter_of = tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_of[codes]
    letter = letter_of[codes]
    codes = np.where(script > 0, lower[codes], 0).astype(np.uint64)
    begins = np.empty(len(codes), bool)
    begins[:1] = True
    begins[1:] = script[1:] != script[:-1]
    before, after = np.zeros_like(codes), np.zeros_like(codes)
    before[1:] = np.where(begins[1:], 0, codes[:-1])
    after[:-1] = np.where(begins[1:], 0, codes[1:])
    at = np.flatnonzero(script)
    mixed = (before[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after[at] * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return at, (mixed >> np.uint64(48)).astype(np.int64), script[at], begins[at], letter[at]


def cut(text: str, most: int = PIECE) -> list[tuple[int, str]]:
    """Pieces of a text with their offsets, cut after white space where there is some."""
    out, at = [], 0
    while len(text) - at > most:
        k = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        end = k + 1 if k > at else at + most
        out.append((at, text[at:end]))
        at = end
    return [*out, (at, text[at:])] if at else [(0, text)]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over whole texts; buckets from BUCKETS on count the letters of each script."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                total = counts.setdefault(lang, np.zeros(BUCKETS + len(NAMES) + 1, np.int64))
                for _, piece in cut("\n".join(texts)):
                    _, bucket, script, _, _ = trigrams(piece)
                    total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script, minlength=len(NAMES) + 1)
        for lang, total in counts.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["lang", "bucket", "n"])

    parts = docs.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities by bucket and language, and the scripts of each language.

    Its size is set by the number of languages: at most 65,536 numbers for each.
    """

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        counts = np.zeros((len(self.langs), BUCKETS + len(NAMES) + 1))
        for lang, bucket, n in rows:
            counts[self.langs.index(lang), bucket] = n
        grams = counts[:, :BUCKETS] + 0.5
        self.scores = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()
        letters = counts[:, BUCKETS:]
        self.uses = (letters >= 0.01 * np.maximum(letters.sum(axis=1, keepdims=True), 1)) & (letters > 0)
        self.uses[:, ~self.uses.any(axis=0)] = True

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: start, end, the scores by language and its number of letters; marks by themselves have none."""
        starts, ends, scores, letters = [], [], [], []
        for offset, piece in cut(text):
            at, bucket, script, begins, letter = trigrams(piece)
            if len(at):
                first = np.flatnonzero(begins)
                last = np.append(first[1:], len(at)) - 1
                sums = np.add.reduceat(self.scores[bucket], first, axis=0)
                sums[~self.uses.T[script[first]]] -= 1e4
                starts.append(at[first] + offset)
                ends.append(at[last] + offset + 1)
                scores.append(sums)
                letters.append(np.add.reduceat(letter, first, dtype=np.int64))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(scores), np.concatenate(letters)


def viterbi(scores: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Best label of each row; ``penalty[i]`` is the price of a switch between rows i-1 and i.

    The rows are cut into blocks that are run side by side, each from every label that may come
    before it; the blocks are then chained, which gives the same path as one pass over all rows.
    """
    n, k = scores.shape
    if not n or k == 1:
        return np.zeros(n, np.int64)
    size = max(1, int(n**0.5))
    blocks = -(-n // size)
    scores = np.concatenate([scores, np.zeros((blocks * size - n, k), scores.dtype)]).astype(np.float64).reshape(blocks, size, k)
    penalty = np.concatenate([penalty, np.zeros(blocks * size - n)]).reshape(blocks, size)
    from_label = np.zeros((size, blocks, k, k), np.uint8 if k < 256 else np.int32)
    value = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(blocks, axis=0)
    own = np.arange(k)
    for t in range(size):
        best = value.argmax(axis=2)[:, :, None]
        jump = np.take_along_axis(value, best, axis=2) - penalty[:, t, None, None]
        from_label[t] = np.where(value >= jump, own, best)
        value = np.maximum(value, jump) + scores[:, t, None, :]
    total, entry = np.zeros(k), np.zeros((blocks, k), np.int64)
    for b in range(blocks):
        through = total[:, None] + value[b]
        entry[b] = through.argmax(axis=0)
        total = through.max(axis=0)
    into, out = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    label = int(total.argmax())
    for b in range(blocks - 1, -1, -1):
        out[b] = label
        into[b] = label = entry[b, label]
    labels, here, each = np.zeros((size, blocks), np.int64), out, np.arange(blocks)
    for t in range(size - 1, -1, -1):
        labels[t] = here
        here = from_label[t, each, into, here]
    return labels.T.reshape(-1)[:n]


def label_texts(model: Model, texts: list[str], switch_penalty: float) -> list[tuple[str, float, list[dict]]]:
    """(language, share of letters, spans) of each text."""
    if not model.langs:
        return [("und", 0.0, []) for _ in texts]
    joined = "\n".join(texts)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends, scores, own = model.words(joined)
    real = own > 0
    starts, ends, scores, own = starts[real], ends[real], scores[real], own[real]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    labels = viterbi(scores, np.where(fresh, 0.0, switch_penalty))
    k = len(model.langs)
    letters = np.bincount(doc * k + labels, weights=own, minlength=len(texts) * k).reshape(-1, k)
    turn = fresh.copy()
    turn[1:] |= labels[1:] != labels[:-1]
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for a, b in zip(first.tolist(), last.tolist()):
        d = int(doc[a])
        spans[d].append({"start": int(starts[a] - offsets[d]), "end": int(ends[b] - offsets[d]), "lang": model.langs[labels[a]]})
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    return [(model.langs[best[i]], float(letters[i, best[i]] / total[i]), spans[i]) if total[i] else ("und", 0.0, []) for i in range(len(texts))]


def learn(docs: DataFrame) -> Model:
    """A model of all documents with a language whose id has a remainder other than 0 by 5."""
    train = docs.where(F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0))
    return Model([tuple(r) for r in count_trigrams(train).collect()])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), switch_penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``keep`` and, for each document, lang_pred, score (its share of the letters) and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, most=2 << 20):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            rows = label_texts(shared.value, texts, switch_penalty)
            yield carried(batch, keep, {"lang_pred": pa.array([r[0] for r in rows], pa.string()), "score": pa.array([r[1] for r in rows], pa.float64()), "spans": pa.array([r[2] for r in rows], SPANS)})

    columns = tuple(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(run, schema_with(docs, keep, RESULT))


def identified(docs: DataFrame, keep: tuple[str, ...], least_share: float = 0.5) -> DataFrame:
    """The documents with letters of which one language has at least ``least_share``."""
    found = identify(docs, learn(docs), keep)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_share)).select(*keep)
