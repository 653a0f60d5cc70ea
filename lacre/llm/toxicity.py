"""Operator 4: toxicity of deobfuscated text by a noisy-channel decoder.

A character language model (all 4-grams of folded letters, with backing off) is counted over the
whole text of all documents. In a text, tokens that look written to dodge a filter (look-alike
digits, symbols and letters of other alphabets inside a word, characters without width, spaced-out
letters, letters repeated three times or more) become
lattices of what may have been meant: each look-alike its letters, each gap nothing or a blank, each
run one or two letters. The Viterbi path through a lattice under the language model is the restored
text; stretches have no length limit, as the path keeps links back and not its text. A document's words, restored ones included, are then scored by how their beginnings (4 and 6
letters) occur in labelled documents whose words went through the same channel.

Learning labels uses at most ``most_labelled`` rows of each label, the first by a hash of doc_id,
from those whose crc32(doc_id as text) has a remainder other than 1 by 3; texts that are alike count
once a label. A beginning is learned if at least 3 % of the toxic texts have it and its odds are
beyond chance.

Defined results: null and empty texts get the score of a text without telling words; with no toxic
labels to learn from every score is 0; a null doc_id is not held out and never learned from; labels
that are null, or of a document that is not there, are left out; repeated rows are scored each time.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column, id_remainder, schema_with, slices, stored

LETTERS = 28
GRAMS = LETTERS**4
OTHER = 27
MOST_LABELLED = 8000
LEAST_SHARE = 0.03
LEAST_G = 30.0
LEAST_WEIGHT = 2.0
STARTS = (4, 6)
#: Longer stretches are decoded each time, so that the memory of decoded ones stays small.
MOST_REMEMBERED = 200
#: What a look-alike may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SYMBOLS = "".join(re.escape(c) for c in LOOKS)
WORD = re.compile(r"[^\W\d_]+")
#: Letters of other alphabets that look like Latin ones, and characters without width.
TWINS = dict(zip("аеорсухіѕјԁһкмтвнαορνικ", "aeopcyxisjdhkmtbhaopvik"))
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SIGN = re.compile(rf"[{SYMBOLS}][^\W\d_]|[^\W\d_][$@0-9€](?![$@0-9€]{{2}})|[A-Za-z][{''.join(TWINS)}]|[{''.join(TWINS)}][A-Za-z]|[^\W\d_][{UNSEEN}]+[^\W\d_]", re.IGNORECASE)
TOKEN = re.compile(rf"[\w{SYMBOLS}{UNSEEN}]+")
SPACED = re.compile(rf"(?<![^\s])(?:[^\W_]|[{SYMBOLS}])(?:(?: ?[.\-_*~/]| )(?:[^\W_]|[{SYMBOLS}])){{3,}}(?![\w])")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
GAPS = " .-_*~/" + UNSEEN
LOOK_COST, GAP_COST, BLANK_COST, DOUBLE_COST = 0.5, 0.1, 1.0, 0.7


def folded(c: str) -> int:
    """1 to 26 for a letter that is or contains a-z, OTHER for other letters, 0 for all else."""
    if not c.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", c.lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else OTHER


@cache
def fold_table() -> np.ndarray:
    table = np.zeros(0x110000, np.int32)
    table[:0x32400] = [folded(chr(c)) for c in range(0x32400)]
    return table


def gram_counts(text: str) -> np.ndarray:
    """Counts of (three symbols before in the word, symbol); a word ends with symbol 0."""
    codes = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([np.zeros(3, np.int32), codes, np.zeros(1, np.int32)])
    b3, b2, b1, own = codes[:-3], codes[1:-2], codes[2:-1], codes[3:]
    real = (own > 0) | (b1 > 0)
    b2 = np.where(b1 > 0, b2, 0)
    b3 = np.where(b2 > 0, b3, 0)
    return np.bincount((((b3 * LETTERS + b2) * LETTERS + b1) * LETTERS + own)[real], minlength=GRAMS)


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) over the whole texts of all documents."""

    def count(batches):
        total = np.zeros(GRAMS, np.int64)
        for batch in slices(batches):
            texts = [t for t in column(batch, "text").to_pylist() if t]
            joined = "\n".join(texts)
            for a in range(0, len(joined), 1 << 20):
                total += gram_counts(joined[a : a + (1 << 20)])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class Speller:
    """Viterbi decoding of character lattices; its table has 614,656 numbers whatever the corpus."""

    def __init__(self, grams: list[tuple[int, int]]):
        counts = np.zeros(GRAMS)
        for gram, n in grams:
            counts[gram] = n
        counts = counts.reshape((LETTERS,) * 4)
        p = np.full(LETTERS, 1 / LETTERS)
        for before in range(4):
            c = counts.sum(axis=tuple(range(3 - before)))
            p = (c + 5.0 * np.broadcast_to(p, c.shape)) / (c.sum(axis=-1, keepdims=True) + 5.0)
        self.scores = np.log(p).ravel().tolist()
        self.known: dict[str, str] = {}

    def lattice(self, token: str):
        """Per step: (text, symbols, cost) of each choice."""
        at, n = 0, len(token)
        while at < n:
            c = token[at]
            run = at + 1
            while run < n and token[run] == c:
                run += 1
            size, at = run - at, run
            if c in GAPS:
                yield [("", (), GAP_COST)] if c in UNSEEN else [("", (), GAP_COST), (" ", (0,), BLANK_COST)]
                continue
            choices = []
            looks = LOOKS.get(c) or TWINS.get(c)
            for letter, cost in [(x, LOOK_COST * size) for x in looks] if looks else [(c, 0.0)]:
                symbol = folded(letter)
                choices.append((letter, (symbol,), cost + (DOUBLE_COST if size == 2 else 0)))
                if size > 1:
                    choices.append((letter * 2, (symbol, symbol), cost + (DOUBLE_COST if size > 2 else 0)))
            yield choices

    def restore(self, token: str) -> str:
        token = token.lower()
        if len(token) > MOST_REMEMBERED:
            return self.decoded(token)
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self.decoded(token)
        return self.known[token]

    def decoded(self, token: str) -> str:
        scores, cube = self.scores, LETTERS**3
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for choices in self.lattice(token):
            after: dict[int, tuple[float, tuple | None]] = {}
            for context, (value, back) in paths.items():
                for new, symbols, cost in choices:
                    c, v = context, value - cost
                    for s in symbols:
                        gram = c * LETTERS + s
                        v += scores[gram]
                        c = gram % cube if s else 0
                    if c not in after or v > after[c][0]:
                        after[c] = (v, (back, new) if new else back)
            paths = after
        back = max(((v + scores[c * LETTERS], t) for c, (v, t) in paths.items()), key=lambda x: x[0])[1]
        out = []
        while back:
            back, new = back
            out.append(new)
        return "".join(reversed(out))


def around(text: str, sign: re.Pattern, token: re.Pattern) -> Iterator[tuple[int, int]]:
    """Each token with such a sign in it. A token is read once however long it is and however many signs it has."""
    end = 0
    while m := sign.search(text, end):
        start = m.start()
        while start > end and token.match(text[start - 1]):
            start -= 1
        end = token.match(text, m.start()).end()
        yield start, end


def restored(text: str, speller: Speller) -> list[tuple[int, int, str]]:
    """(start, end, text) of each obfuscated stretch and what it stands for; overlaps go to the first."""
    if not text:
        return []
    found = [m.span() for m in SPACED.finditer(text)]
    found += [*around(text, SIGN, TOKEN), *around(text, TRIPLE, WORD)]
    out, end = [], 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((a, b, speller.restore(text[a:b])))
            end = b
    return out


def words_of(text: str, stretches: list[tuple[int, int, str]]) -> set[str]:
    """The different words of a text and of its restored stretches."""
    words = set(WORD.findall(text.lower()))
    for _, _, new in stretches:
        words.update(WORD.findall(new))
    return words


def starts_of(word: str) -> set[str]:
    return {word[:k] for k in STARTS}


def sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each label, of documents that are not held out."""
    rows = labels.where(F.col("toxic").isin(0, 1) & (id_remainder(F.col("doc_id"), 3) != 1)).select("doc_id", "toxic").distinct()
    parts = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


class Weights:
    """Log rates of telling word beginnings, toxic over clean, and how their sum becomes a score.

    A word counts for the most significant of its beginnings that is in the table; beginnings are
    chosen by the likelihood ratio test of their two rates among different words. What a text shows
    is the sum of its words' weights, the largest of them and its number of words; a logistic
    regression over the labelled sample makes a probability of it, with the odds of all labels.
    """

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.weights: dict[str, float] = {}
        self.g: dict[str, float] = {}
        self.coef = np.zeros(4)
        total = {r[0]: r for r in rows}.get("", ("", 0, 0, 0))
        for start, n0, n1, d1 in rows:
            weight = math.log((n1 + 0.5) / (total[2] + 1)) - math.log((n0 + 0.5) / (total[1] + 1))
            mean = (n1 + n0) / (total[2] + total[1] + 1)
            g = 2 * sum(n * math.log(n / (mean * all_)) for n, all_ in ((n1, total[2]), (n0, total[1])) if n)
            if start and d1 >= max(3, LEAST_SHARE * total[3]) and weight >= LEAST_WEIGHT and g >= LEAST_G:
                self.weights[start], self.g[start] = weight, g
        self.roots = {x[: min(STARTS)] for x in self.weights}

    def telling(self, word: str) -> str | None:
        return max((x for x in starts_of(word) if x in self.weights), key=self.g.__getitem__, default=None)

    def evidence(self, words: set[str]) -> tuple[float, float, float, float]:
        least, roots = min(STARTS), self.roots
        found = [self.weights[x] for x in (self.telling(w) for w in words if w[:least] in roots) if x]
        return 1.0, sum(found), max(found, default=0.0), math.log1p(len(words))

    def fit(self, x: np.ndarray, y: np.ndarray, odds: float) -> None:
        """Newton steps with a ridge; the sample's odds are replaced by ``odds``."""
        if not odds or not y.any():
            self.coef = np.array([-np.inf, 0, 0, 0])
            return
        coef = np.zeros(4)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
            slope = x.T @ (y - p) - 0.1 * coef
            coef = coef + np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 0.1 * np.eye(4), slope)
        coef[0] += math.log(odds) - math.log(y.sum() / max(len(y) - y.sum(), 1))
        self.coef = coef

    def score(self, words: set[str]) -> float:
        if self.coef[0] == -np.inf:
            return 0.0
        return 1 / (1 + math.exp(-min(max(float(np.dot(self.coef, self.evidence(words))), -500), 500)))


def learn(docs: DataFrame, labels: DataFrame, speller, most_labelled: int = MOST_LABELLED) -> Weights:
    """``speller`` is a broadcast Speller. The sample's ids, at most twice ``most_labelled``, are broadcast."""
    chosen = F.broadcast(sample(labels, most_labelled))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").select("text", "toxic").dropDuplicates()
    rows = stored(rows)

    def count(batches):
        n: dict[str, list[int]] = {"": [0, 0, 0]}
        for batch in slices(batches, most=1 << 20):
            for text, y in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist()):
                words = words_of(text, restored(text, speller.value))
                found = Counter(x for w in words for x in starts_of(w))
                found[""] = len(words)
                for start, k in found.items():
                    cell = n.setdefault(start, [0, 0, 0])
                    cell[y] += k
                    cell[2] += y
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([v[i] for v in n.values()], pa.int64()) for i in range(3))], names=["start", "n0", "n1", "d1"])

    counts = rows.mapInArrow(count, "start string, n0 bigint, n1 bigint, d1 bigint").groupBy("start").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d1")))
    total = counts.where("start = ''").first()
    least = max(3, LEAST_SHARE * total["d1"]) if total else 0
    found = counts.where((F.col("start") == "") | (F.col("d1") >= F.lit(least)))  # at most a text's mean number of words times 1 / LEAST_SHARE
    weights = Weights([tuple(r) for r in found.collect()])

    def show(batches):
        for batch in slices(batches, most=1 << 20):
            shown = [weights.evidence(words_of(t, restored(t, speller.value))) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x in shown], pa.list_(pa.float64())), column(batch, "toxic").cast(pa.int32())], names=["x", "y"])

    shown = rows.mapInArrow(show, "x array<double>, y int").collect()
    n = labels.where(F.col("toxic").isin(0, 1) & (id_remainder(F.col("doc_id"), 3) != 1)).agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first()
    weights.fit(np.array([r[0] for r in shown]).reshape(-1, 4), np.array([r[1] for r in shown], float), (n[1] or 0) / max(n[0] or 0, 1))
    return weights


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``keep``, score and restored: (start, end, text) of each stretch that was decoded."""
    sc = docs.sparkSession.sparkContext
    speller = sc.broadcast(Speller([tuple(r) for r in count_grams(docs).collect()]))
    weights = sc.broadcast(learn(docs, labels, speller, most_labelled))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches):
        for batch in slices(batches):
            scores, stretches = [], []
            for text in column(batch, "text").to_pylist():
                text = text or ""
                found = restored(text, speller.value)
                scores.append(weights.value.score(words_of(text, found)))
                stretches.append([{"start": a, "end": b, "text": t} for a, b, t in found])
            yield carried(batch, keep, {"score": pa.array(scores, pa.float64()), "restored": pa.array(stretches, spans)})

    columns = tuple(dict.fromkeys([*keep, "text"]))
    schema = schema_with(docs, keep, "score double, restored array<struct<start: int, end: int, text: string>>")
    return docs.select(*columns).mapInArrow(run, schema)
