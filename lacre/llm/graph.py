"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge other than the least of its component, its root.

    ``edges`` has two columns a and b of one type. Alternating large and small stars: each round
    hangs a node's neighbours under the least of them, until every component is a star. Loops and
    repeated edges do no harm; rows with a null end are left out. Each round is written to the
    shared checkpoint folder, so a lost executor costs one round at most.
    """
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    stars = stored(kept.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    mark = None
    while True:
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
        if now == mark or not now[0]:
            return stars
        mark = now
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").where("root > least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        stars = stored(small.unionByName(least.select("node", F.col("least").alias("root"))).distinct())
