"""Operator 6: exact top-k search by integer inner product with an M-tree.

A component x becomes floor(scale * x). An inner product is turned into a distance by one more
coordinate: with m the largest norm, x' = (x, sqrt(m^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + m^2 - 2 q.x, so the nearest are those of the highest product and the triangle
inequality holds.

The tree has three levels. Root entries are pivots from a bounded sample (``most_roots`` rows by a
hash of their id; every vector is indexed). A vector belongs to its nearest pivot; what one pivot
attracts beyond ``node_rows`` is split into several nodes under the same pivot, so no task holds a
larger node however many vectors there are. Within a node, pages of
about ``page_rows`` vectors have a routing vector, a covering radius and their entries' distances to it.
Each query first searches the node of the least bound, best page first, which gives it a k-th score;
then it goes to the other nodes whose covering radius does not rule them out. In a page only
entries whose stored parent distance lies within reach of the query's are computed. Bounds give way
by a rounding margin; scores are exact.

Queries are all rows whose id is divisible by ``query_step``, dealt in blocks of ``block_rows``.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor
do those without an id; shorter vectors count as filled up with zeros; a row is never found for
its own id; rows repeated in full are found as often as they are there, and asked once; an empty
table gives no rows. Scores must stay below 2 ** 53, where doubles are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, stored

K = 20
SCALE = 64
QUERY_STEP = 20
MOST_ROOTS = 1024
NODE_ROWS = 16_384
PAGE_ROWS = 192
BLOCK_ROWS = 16_384
HITS = "query_id bigint, vec_id bigint, score bigint"


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles with whole values."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return table.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Rows filled up with zeros to ``size`` columns."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(len(lists), size)
    out = np.zeros((len(lists), size))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Node:
    """Pages of one node: routing vectors, covering radii, and entries by their parent distance."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm2: float, page_rows: int):
        up = lifted(x, norm2)
        count = max(1, len(x) // page_rows)
        self.route = up[np.random.default_rng(7).choice(len(x), count, replace=False)]
        near = np.empty(len(x), np.int64)
        parent = np.empty(len(x))
        for a in range(0, len(x), 8192):
            d = distances(up[a : a + 8192], self.route)
            near[a : a + 8192] = d.argmin(axis=1)
            parent[a : a + 8192] = d.min(axis=1)
        order = np.lexsort((parent, near))
        self.ids, self.x, self.parent = ids[order], x[order], parent[order]
        self.begin = np.searchsorted(near[order], np.arange(count + 1))
        self.radius = np.array([self.parent[b - 1] if b > a else -math.inf for a, b in zip(self.begin, self.begin[1:])])

    def search(self, query: np.ndarray, query_id: int, to_pages: np.ndarray, reach: float, floor: float, base: float, margin: float, k: int):
        """The k best (score, id) at least ``floor``; ``reach`` is the distance of that score, ``base`` |q|^2 + m^2."""
        bound = to_pages - self.radius
        best_score, best_id = np.zeros(0), np.zeros(0, np.int64)
        for p in np.argsort(bound):
            if bound[p] > reach + margin:
                break
            a, b = int(self.begin[p]), int(self.begin[p + 1])
            parent = self.parent[a:b]
            low, high = np.searchsorted(parent, (to_pages[p] - reach - margin, to_pages[p] + reach + margin))
            a, b = a + int(low), a + int(high)
            if a == b:
                continue
            score = self.x[a:b] @ query
            ok = np.flatnonzero((score >= floor) & (self.ids[a:b] != query_id))
            if not len(ok):
                continue
            best_score, best_id = np.append(best_score, score[ok]), np.append(best_id, self.ids[a:b][ok])
            if len(best_score) > k:
                order = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[order], best_id[order]
            if len(best_score) == k:
                floor = max(floor, best_score.min())
                reach = math.sqrt(max(base - 2 * floor, 0))
        return best_score, best_id


def top_k(table: DataFrame, k: int = K, scale: int = SCALE, query_step: int = QUERY_STEP, most_roots: int = MOST_ROOTS, node_rows: int = NODE_ROWS, page_rows: int = PAGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest scores, ties to the smaller id."""
    spark = table.sparkSession
    vectors = whole_vectors(table, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, size, norm2 = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    roots = min(most_roots, math.ceil(total / node_rows))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(roots).select("v").collect()
    pivots = lifted(np.array([r[0] + [0.0] * (size - len(r[0])) for r in chosen]).reshape(len(chosen), size), norm2)
    margin = 1e-6 * (1 + math.sqrt(norm2))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(matrix(column(batch, "v"), size), norm2), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=["vec_id", "v", "root", "parent"])

    # Stored, as the sizes and both searches need it; distances to the pivots are computed once.
    held = stored(vectors.mapInArrow(assign, "vec_id bigint, v array<double>, root int, parent double"))
    nodes, radius, first = {}, np.full(len(pivots), -math.inf), 0
    for r in held.groupBy("root").agg(F.count("*").alias("n"), F.max("parent").alias("radius")).orderBy("root").collect():
        nodes[r["root"]] = (first, math.ceil(r["n"] / node_rows))
        radius[r["root"]] = r["radius"]
        first += nodes[r["root"]][1]
    first_of = F.create_map(*(F.lit(x) for root, (a, n) in nodes.items() for x in (root, a)))
    count_of = F.create_map(*(F.lit(x) for root, (a, n) in nodes.items() for x in (root, n)))
    held = held.withColumn("node", F.element_at(first_of, F.col("root")) + F.pmod(F.xxhash64("vec_id", "v"), F.element_at(count_of, F.col("root"))).cast("int"))

    queries = vectors.where(F.col("vec_id") % query_step == 0).distinct()
    blocks = max(1, math.ceil(queries.count() / block_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("q", F.xxhash64("vec_id", "v"))

    first_node, n_nodes = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    for root, (a, n) in nodes.items():
        first_node[root], n_nodes[root] = a, n

    def route(batches, rest: bool):
        """Send each query to one node of the root of the least bound, or to all others in reach. Bounds are by root."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                x = matrix(column(part, "v"), size)
                bound = distances(np.column_stack([x, np.zeros(len(x))]), pivots) - np.where(n_nodes > 0, radius, -np.inf)
                best = bound.argmin(axis=1)
                own = first_node[best] + np.abs(column(part, "q").to_numpy()) % n_nodes[best]
                if rest:
                    floor = column(part, "floor").to_numpy(zero_copy_only=False)
                    reach = np.sqrt(np.maximum((x * x).sum(axis=1) + norm2 - 2 * np.where(np.isfinite(floor), floor, 0), 0))
                    row, root = np.nonzero(~np.isfinite(floor)[:, None] | (bound <= reach[:, None] + margin))
                    count = n_nodes[root]
                    node = np.repeat(first_node[root] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    row = np.repeat(row, count)
                    row, node = row[node != own[row]], node[node != own[row]]
                else:
                    row, node = np.arange(len(x)), own
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(node.astype(np.int32))], names=[*taken.schema.names, "to"])

    def search(key, rows, asked):
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        node = Node(rows["vec_id"].to_numpy(), matrix(rows["v"], size), norm2, page_rows)
        x = matrix(asked["v"], size)
        names, ids, floors = asked["q"].to_numpy(), asked["vec_id"].to_numpy(), asked["floor"].to_numpy()
        found: list[tuple] = []
        for a in range(0, len(x), 1024):
            to_pages = distances(np.column_stack([x[a : a + 1024], np.zeros(len(x[a : a + 1024]))]), node.route)
            for i, pages in enumerate(to_pages, a):
                base, floor = float(x[i] @ x[i]) + norm2, floors[i]
                reach = math.sqrt(max(base - 2 * floor, 0)) if math.isfinite(floor) else math.inf
                score, vec = node.search(x[i], ids[i], pages, reach, floor, base, margin, k)
                found.append((np.full(len(vec), names[i]), np.full(len(vec), ids[i]), vec, score.astype(np.int64)))
        return pa.table([np.concatenate(c) for c in zip(*found)], names=["q", "query_id", "vec_id", "score"])

    def searched(routed: DataFrame) -> DataFrame:
        each = held.select("vec_id", "v", "node") if blocks == 1 else held.select("vec_id", "v", "node", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        each = each.withColumn("b", F.lit(0)) if blocks == 1 else each
        return each.groupBy("node", "b").cogroup(routed.groupBy("to", "block")).applyInArrow(search, "q bigint, " + HITS)

    fields = "vec_id bigint, v array<double>, block int, q bigint, floor double, to int"
    start = queries.withColumn("floor", F.lit(-math.inf))
    near = searched(start.mapInArrow(lambda it: route(it, False), fields))
    floors = near.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth")).select(F.col("q").alias("_q"), "kth")
    again = queries.join(floors, F.col("q") == F.col("_q"), "left").select("vec_id", "v", "block", "q", F.coalesce("kth", F.lit(-math.inf)).alias("floor"))
    far = searched(again.mapInArrow(lambda it: route(it, True), fields))
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
