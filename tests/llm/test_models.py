"""Operators 11 to 13 against plain Python."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacre.llm import centroids, pitman_yor, seating, whitening

VECTORS = "vec_id bigint, embedding array<double>, v int, y string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)


def odd_rows(size):
    return [(None, [0.25] * size), (900, None), (901, [None] * size), (902, [math.nan] * size), (903, [math.inf] + [0.0] * (size - 1)), (904, [])]


def kept(rows, size=None):
    return [(i, [float(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and (size is None or len(v) == size)]


# --- centroids


def brute_clusters(rows, k=8, rounds=10, size=4):
    points = [(i, [math.floor(1024 * x) for x in v]) for i, v in kept(rows, size)]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in points)[:k]
    centres = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in points]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, at) in zip(points, found) if at == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    fits = lambda x: x if x < 2**63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), names[j]) for (i, _), (d, j) in zip(points, found))


@pytest.mark.parametrize("spread,block", [(1.0, 4096), (1.0, 7), (3e4, 16), (4e5, 16), (1e18, 16)])
def test_clusters_are_brute_force(spark, spread, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) * spread * (1 + i % 3)]) for i in range(120)]
    rows += [rows[3], rows[3], (500, rows[4][1]), (501, [1.0] * 3), (502, [1.0] * 5), *odd_rows(4)]
    table = vectors(spark, rows).repartition(3)
    found = centroids.cluster_vectors(table, dimensions=4, block_rows=block)
    assert Counter(tuple(r) for r in found.collect()) == brute_clusters(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [-0.5, 0.5]), (2, [-0.5, 0.5])]
    table = vectors(spark, rows)
    assert Counter(tuple(r) for r in centroids.cluster_vectors(table, dimensions=2).collect()) == brute_clusters(rows, size=2)
    assert centroids.cluster_vectors(table).count() == 0
    assert centroids.cluster_vectors(table.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distances_stay_exact_at_every_bound():
    rng = np.random.default_rng(5)
    for top in (2**20, 2**26, 2**31, 2**60):
        x = np.floor(rng.normal(size=(40, 6)) * top)
        centres = [[int(c) for c in row] for row in np.floor(rng.normal(size=(3, 6)) * top)]
        label, distance = centroids.nearest(x, centres)
        want = [min((sum((int(a) - b) ** 2 for a, b in zip(row, c)), j) for j, c in enumerate(centres)) for row in x.tolist()]
        assert [(int(d), int(j)) for d, j in zip(distance.tolist(), label)] == want
        assert centroids.total(distance) == sum(d for d, _ in want)
        sums = centroids.summed(x, label, 3)
        assert [[sum(int(row[i]) for row, at in zip(x.tolist(), label) if at == j) for i in range(6)] for j in range(3)] == sums.tolist()


# --- whitening


def check_whitening(rows, found, size, most):
    usable = [(i, [math.floor(64 * x) + 1_000_000 for x in v + [0.0] * (size - len(v))]) for i, v in kept(rows) if all(abs(64 * x) < 2**52 for x in v)]
    n = len(usable)
    sums = [sum(c) for c in zip(*(v for _, v in usable))]
    apart = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for _, v in usable])
    covariance = apart.T @ apart / n
    values = np.linalg.eigvalsh(covariance)[::-1][:most]
    got = found.rows.collect()
    assert found.n == n == len(got)
    assert Counter((i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in usable) == Counter((r["vec_id"], int(r["deviation"])) for r in got)
    white = np.array([[np.nan if x is None else x for x in r["whitened"]] for r in got])
    real = values > whitening.LEAST * values[0]
    assert np.isnan(white[:, ~real]).all()
    white = white[:, real]
    np.testing.assert_allclose(found.explained, np.maximum(values, 0) / np.trace(covariance), rtol=1e-6, atol=1e-12)
    centred = white - white.mean(axis=0)
    error = np.abs(centred.T @ centred / n - np.eye(white.shape[1])).max()
    assert error < 1e-6 and abs(found.identity_error - error) < 1e-6
    # The rows stand as x does: the same distances as in whitened coordinates made here.
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :most][:, real]
    mine = apart @ axes / np.sqrt(values[real])
    by_row = {(r["vec_id"], int(r["deviation"])): w for r, w in zip(got, white)}
    theirs = np.array([by_row[(i, sum((n * a - s) ** 2 for a, s in zip(v, sums)))] for i, v in usable])
    np.testing.assert_allclose(np.abs(theirs), np.abs(mine), rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("size,spread", [(5, 1.0), (40, 1.0), (5, 2e10)])
def test_whitening_is_plain_numpy(spark, size, spread):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(size, size))
    rows = [(i, [float(x) for x in mix @ rng.normal(size=size) * spread]) for i in range(200)]
    rows += [rows[3], rows[3], (300, [1.0]), (301, [2.0**60] * size), *odd_rows(size)]
    found = whitening.whiten(vectors(spark, rows).repartition(3))
    check_whitening(rows, found, size, min(32, size))


def test_dimensions_without_variance(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, float(rng.normal()), 0.5, float(rng.normal())]) for i in range(60)]
    check_whitening(rows, whitening.whiten(vectors(spark, rows)), 4, 4)
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.25])] * 3))
    assert same.explained == [0.0, 0.0] and same.identity_error == 0.0
    assert [(r["vec_id"], r["deviation"], r["whitened"]) for r in same.rows.collect()] == [(1, 0, [None, None])] * 3
    assert whitening.whiten(vectors(spark, odd_rows(3)[1:])) is None
    assert whitening.whiten(vectors(spark, []).limit(0)) is None


# --- language model


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def remainder(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7


def check_contract(docs, found):
    learned = Counter(t for i, text in docs if remainder(i) not in (None, 2) for t in tokens_of(text))
    n, v = sum(learned.values()), len(learned)
    want = Counter()
    for i, text in docs:
        t = tokens_of(text)
        want[(i, remainder(i) == 2, len(t), sum(learned[x] > 0 for x in t), n, round(sum(math.log10((learned[x] + 1) / (n + v + 1)) for x in t), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    for r in found:
        assert len(r["token_scores"]) == r["n_tokens"] and math.isclose(sum(r["token_scores"]), r["score"], rel_tol=1e-9, abs_tol=1e-9)
        assert all(s <= 1e-12 for s in r["token_scores"]) and math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]), rel_tol=1e-9)
    return learned


@pytest.mark.parametrize("word_bytes,pair_bytes", [(4 << 20, 8 << 20), (2000, 3000)])
def test_scores_of_texts(documents, nothing, monkeypatch, word_bytes, pair_bytes):
    monkeypatch.setattr(pitman_yor, "WORD_BYTES", word_bytes)
    monkeypatch.setattr(pitman_yor, "PAIR_BYTES", pair_bytes)
    found = pitman_yor.score_texts(documents).collect()
    check_contract([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()], found)
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 5]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = pitman_yor.score_texts(documents.repartition(1)).collect()
    assert {r["doc_id"]: r["n_known"] for r in again} == {r["doc_id"]: r["n_known"] for r in found}
    assert pitman_yor.score_texts(nothing).count() == 0


@pytest.mark.parametrize("bytes_", [1 << 20, 100])
def test_probabilities_sum_to_one(spark, monkeypatch, bytes_):
    """After each context, over all learned words, the end and the unknown."""
    monkeypatch.setattr(pitman_yor, "WORD_BYTES", bytes_)
    monkeypatch.setattr(pitman_yor, "PAIR_BYTES", bytes_)
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(12)]
    train = [(f"t{i}", " ".join(rng.choice(words, p=np.arange(1, 13) / 78, size=int(rng.integers(0, 40))))) for i in range(4000) if remainder(f"t{i}") != 2][:60]
    ids = (f"h{i}" for i in itertools.count() if remainder(f"h{i}") == 2)
    contexts = ["w3", "w11", "unknown"]
    held = [(next(ids), f"{u} {w}", u) for u in contexts for w in [*words, "never"]] + [(next(ids), u, u) for u in contexts]
    table = spark.createDataFrame([(i, t, 1) for i, t, *_ in train + held], "doc_id string, text string, kind int").repartition(3)
    found = {r["doc_id"]: r for r in pitman_yor.score_texts(table).collect()}
    check_contract([(i, t) for i, t, *_ in train + held], list(found.values()))
    for u in contexts:
        assert math.isclose(sum(10 ** found[i]["token_scores"][1] for i, _, own in held if own == u), 1.0, abs_tol=1e-9)


def test_nothing_learned(spark):
    table = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    found = pitman_yor.score_texts(table).collect()
    check_contract([(None, "a b"), (None, None)], found)
    assert [r["score"] for r in found] == [0.0, 0.0]


def test_a_long_text_and_common_pairs(spark):
    long = "to be or not " * 60_000
    i = next(i for i in range(10, 99) if remainder(i) != 2)
    rows = [(i, long), (2, "to be"), (3, "not to"), (4, ""), (4, None)]
    found = pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_contract(rows, found)
    assert min(r["score"] / r["n_tokens"] for r in found if r["doc_id"] == i) > -0.05


def partitions(n):
    """Sizes of the blocks of each way to seat n customers."""
    if not n:
        return [()]
    out = []
    for first in range(1, n + 1):
        for rest in itertools.combinations(range(n - 1), first - 1):
            out += [(first, *p) for p in partitions(n - 1 - len(rest))]
    return out


@pytest.mark.parametrize("n,weight,discount", [(2, 0.3, 0.75), (5, 0.4, 0.75), (6, 2.0, 0.3)])
def test_gibbs_reaches_the_seating_distribution(n, weight, discount):
    chance = Counter()
    for p in partitions(n):
        chance[len(p)] += weight ** len(p) * math.prod(math.prod(i - discount for i in range(1, size)) for size in p)
    mean = sum(t * c for t, c in chance.items()) / sum(chance.values())
    found = pitman_yor.seats(np.full(40_000, n), np.full(40_000, weight), discount, 12, 2, np.random.default_rng(1))
    assert abs(found.mean() - mean) < 0.02
    for t, c in chance.items():
        assert abs((found == t).mean() - c / sum(chance.values())) < 0.015


def test_seats_of_large_dishes():
    rng = np.random.default_rng(2)
    customers = np.array([0, 1, 2, 300, 5000, 10**9])
    found = pitman_yor.seats(customers, np.full(6, 0.01), 0.75, 1, 2, rng)
    assert (found[:, 0] == 0).all() and (found[:, 1] == 1).all()
    assert ((found >= np.minimum(customers, 1)) & (found <= customers)).all()
    assert (found[:, 4] >= 5000 // pitman_yor.ROOM).all() and (found[:, 5] > found[:, 4]).all()


def test_every_room_of_a_large_dish_is_drawn():
    """The number of tables has the mean and the spread of rooms that are all seated, not of some that stand for the rest."""
    rooms, weight, discount = 1000, 1.0, 0.75
    ways = [Decimal(0), Decimal(1)]
    for n in range(1, pitman_yor.ROOM):
        ways = [Decimal(0)] + [ways[t - 1] + ((n - t * Decimal(discount)) * ways[t] if t <= n else 0) for t in range(1, n + 2)]
    chance = np.array([float(x / sum(ways)) for x in ways])
    mean = chance @ np.arange(len(chance))
    spread = (chance @ (np.arange(len(chance)) - mean) ** 2 * rooms) ** 0.5
    found = pitman_yor.seats(np.full(300, rooms * pitman_yor.ROOM), np.full(300, weight), discount, 2, 1, np.random.default_rng(4))[0]
    assert abs(found.mean() - rooms * mean) < 5 * spread / 300**0.5
    assert 0.8 < found.std() / spread < 1.25
    exact = np.exp(pitman_yor.seatings(6, 0.3)[6, 1:])
    sums = Counter()
    for p in partitions(6):
        sums[len(p)] += math.prod(math.prod(i - 0.3 for i in range(1, size)) for size in p)
    assert np.allclose(exact, [sums[t] for t in range(1, 7)])


@pytest.mark.parametrize("n,weight", [(60, 0.05), (200, 2.0)])
def test_seating_needs_no_sweeps_before_it(n, weight):
    """The first sample has the exact mean and spread already, without any burn-in."""
    ways = [Decimal(0), Decimal(1)]
    for k in range(1, n):
        ways = [Decimal(0)] + [ways[t - 1] + ((k - t * Decimal(0.75)) * ways[t] if t <= k else 0) for t in range(1, k + 2)]
    chance = [x * Decimal(weight) ** t for t, x in enumerate(ways)]
    chance = np.array([float(x / sum(chance)) for x in chance])
    mean = chance @ np.arange(len(chance))
    spread = (chance @ (np.arange(len(chance)) - mean) ** 2) ** 0.5
    found = pitman_yor.seats(np.full(20_000, n), np.full(20_000, weight), 0.75, 0, 1, np.random.default_rng(6))[0]
    assert abs(found.mean() - mean) < 5 * spread / 20_000**0.5 and 0.95 < found.std() / spread < 1.05


def tables_of_all(n, weight):
    """Mean and spread of the number of tables, all customers of a dish in one room."""
    t = np.arange(1, n + 1)
    chance = pitman_yor.seatings(n, 0.75)[n, 1:] + t * math.log(weight)
    chance = np.exp(chance - chance.max())
    mean = chance @ t / chance.sum()
    return mean, (chance @ (t - mean) ** 2 / chance.sum()) ** 0.5


@pytest.mark.parametrize("n,weight", [(257, 0.05), (900, 1.0), (900, 30.0), (900, 5000.0)])
def test_dishes_of_any_size_are_seated_whole(n, weight):
    """A large dish's customers may all share tables, in the model's own steps as well: rooms of some of them have more."""
    mean, spread = tables_of_all(n, weight)
    found = pitman_yor.seats(np.full(4000, n), np.full(4000, weight), 0.75, 0, 1, np.random.default_rng(7), whole=True)[0]
    assert abs(found.mean() - mean) < 5 * spread / 4000**0.5 and 0.9 < found.std() / spread < 1.1
    grade = round(math.log2(weight) * 4) + 160
    mean, spread = tables_of_all(n, 2 ** ((grade - 160) / 4))
    own = [np.arange(1, 501), np.zeros(500, np.int64), np.full(500, n), np.full(500, grade)]
    own[0] = np.diff(own[0], prepend=0)
    rows = pitman_yor.seat_pairs(1, 0, 2)(pitman_yor.table_of([(0, 0, pitman_yor.PAIRS, 500, None, *map(pitman_yor.packed, own))])).to_pylist()
    seat = pitman_yor.unpacked(next(r["b"] for r in rows if r["kind"] == pitman_yor.PAIRS), 500)
    assert abs(seat.mean() / 2 - mean) < 5 * spread / 1000**0.5
    parent = {"c": pitman_yor.packed(np.full(500, n)), "n": 500, "m": 1, "to": 0}
    _, seat = pitman_yor.parent_tables(parent, 1, weight, [0], 0)
    mean, spread = tables_of_all(n, weight)
    assert abs(seat.mean() - mean) < 5 * spread / 500**0.5


@pytest.mark.parametrize("discount", [0.3, 0.75])
def test_seatings_of_many_customers(discount):
    table = pitman_yor.seatings(1200, discount)
    for n in (257, 1200):
        t = np.arange(1, n + 1)
        assert np.abs(seating.log_seatings(np.full(n, n), t, discount) - table[n, 1 : n + 1]).max() < 1e-7
    # S(n + 1, t) = S(n, t - 1) + (n - d t) S(n, t), far beyond a table.
    t = np.array([2, 50, 10_000, 1_000_000, 9_999_999])
    n = np.full(5, 10_000_000)
    rest = np.logaddexp(seating.log_seatings(n, t - 1, discount), seating.log_seatings(n, t, discount) + np.log(n - discount * t))
    assert np.abs(seating.log_seatings(n + 1, t, discount) - rest).max() < 1e-5


@pytest.mark.parametrize("shift", [0, 1 << 32])
def test_counts_of_pairs_in_lists(shift):
    """Each list gets the counts of all lists in its own order, also with numbers too large for one key."""
    lists = [[(1, 2, 3), (1, 5, 1), (4, 1, 2)], [(1, 2, 1), (4, 1, 5), (4, 2, 1)]]
    rows = []
    for i, own in enumerate(lists):
        u, w, uses = (np.array(x, np.int64) for x in zip(*own))
        rows.append((0, i, pitman_yor.PAIRS, len(own), None, *map(pitman_yor.packed, (np.diff(u + shift, prepend=0), w + shift, uses, np.full(len(own), 160)))))
    found = pitman_yor.seat_pairs(2, 0, 3)(pitman_yor.table_of(rows)).to_pylist()
    counts = {r["to"]: pitman_yor.unpacked(r["a"], r["n"]).tolist() for r in found if r["kind"] == pitman_yor.PAIRS}
    assert counts == {0: [4, 1, 7], 1: [4, 7, 1]}
    tables = [pitman_yor.unpacked(r["b"], r["n"]).sum() for r in found if r["kind"] == pitman_yor.TABLES]
    assert 3 * 4 <= sum(tables) <= 3 * 13


@pytest.mark.parametrize("values", [[], [0], [0, 0, 5], [255, 256, 2**40], [2**62]])
def test_packed_numbers(values):
    assert pitman_yor.unpacked(pitman_yor.packed(np.array(values, np.int64)), len(values)).tolist() == values
    assert [(v, b - a) for v, a, b in pitman_yor.runs(np.array(sorted(values), np.int64))] == [(k, len(list(g))) for k, g in itertools.groupby(sorted(values))]


def test_common_words_are_dealt_by_context(monkeypatch):
    monkeypatch.setattr(pitman_yor, "HOT", 1)
    rows = [dict(to=0, source=0, kind=pitman_yor.TEXT, n=6, m=1, a=np.arange(4, dtype="<u8").tobytes(), b=pitman_yor.packed(np.array([1, 2, 3, 2, 1, 0])), c=pitman_yor.packed(np.array([6])), d=b"\x01", ids=[1])]
    rows += [dict(to=0, source=0, kind=pitman_yor.WORDS, n=4, a=pitman_yor.packed(np.array([1, 2, 3, 0])), b=pitman_yor.packed(np.array([1, 2, 2, 0])))]
    which, u, w, uses, pair = pitman_yor.Batch(rows).pairs(5)
    assert sorted(zip(u.tolist(), w.tolist(), uses.tolist())) == [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1)]
    assert [(int(u[p]), int(w[p])) if p >= 0 else None for p in pair] == [(0, 1), (1, 2), None, None, (2, 1), (1, 0)]
    assert sorted(which.tolist()) == which.tolist()


def test_queries_have_their_columns(spark):
    from lacre.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    white = QUERIES["op11_whitening"](spark, sf)
    assert white.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert white.count() == 32 * white.select("vec_id").distinct().count() and white.where(F.col("identity_error") > 1e-4).count() == 0
    scored = QUERIES["op12_pitman_yor"](spark, sf)
    assert scored.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
