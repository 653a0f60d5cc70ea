"""Operator 11: embedding whitening with Spark MLlib's RowMatrix.

A component c becomes the long x = floor(scale * c) + shift. With n vectors and sums S, a row is
centred as n * x - S, which is a whole number: in longs where n times the largest magnitude fits,
else in decimals. Only then it becomes a double, divided by n, so the shift, which is large beside the
spread, never meets a rounding. RowMatrix.computeGramianMatrix of the centred rows divided by n is
the covariance V; numpy's eigh of that d x d matrix runs on the driver, and the projection (d x 32
doubles at most) is broadcast to mapInPandas. The whitened rows are stored, centred by their own
mean and measured by a second RowMatrix, which gives ``identity_error``.

Defined results: vectors that are null, hold a null or non-finite component, or one whose scaled
magnitude is 2^52 or more (where a double has no whole numbers to spare) take no part and are not
counted; shorter vectors count as filled up with zeros; a null vec_id is kept; repeated rows count
each; an empty table, and vectors without any component, give no rows. A component whose variance is
not above 1e-11 of the largest cannot be told from rounding: its ``whitened`` is null and it is not
part of ``identity_error``. ``explained`` is 0 where all vectors are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
LEAST = 1e-11


@dataclass
class Whitened:
    """``rows``: vec_id, deviation (decimal(38,0)), whitened (array of doubles); numbers of the fit beside it."""

    rows: DataFrame
    n: int
    explained: list[float]
    identity_error: float


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, y): floor(scale * c) of the vectors that take part."""
    scaled = F.transform("embedding", lambda c: c.cast("double") * scale)
    usable = F.col("embedding").isNotNull() & F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < 2.0**52))
    return table.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(scaled, lambda y: F.floor(y)).alias("y"))


def gramian(rows: DataFrame, col: Column, d: int) -> np.ndarray:
    """The sum over all rows of the outer product of a column of doubles with itself."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(col).alias("v")), "v")
    return RowMatrix(vectors, numCols=d).computeGramianMatrix().toArray()


def dimension_sums(rows: DataFrame, col: str) -> list:
    """Of each dimension: (sum, largest magnitude); one row a dimension reaches the driver."""
    parts = rows.select(F.posexplode(col).alias("i", "y")).groupBy("i")
    exact = F.sum("y") if dict(rows.dtypes)[col] == "array<double>" else F.sum(F.col("y").cast("decimal(20,0)"))
    return [(r["s"], r["m"]) for r in parts.agg(exact.alias("s"), F.max(F.abs("y")).alias("m")).orderBy("i").collect()]


def whiten(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitened | None:
    """All vectors that take part, projected on the components of greatest variance and divided by its root."""
    spark = table.sparkSession
    rows = whole_vectors(table, scale)
    n, least, d = rows.agg(F.count("*"), F.min(F.size("y")), F.max(F.size("y"))).first()
    if not n or not d:
        return None
    if least < d:
        rows = rows.withColumn("y", F.concat("y", F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size("y"))))
    # x = y + shift: n * x - S is n * y minus the sum of y, as n * shift goes out exactly.
    found = dimension_sums(rows, "y")
    sums, top = [int(s) for s, _ in found], max(m for _, m in found)
    narrow = n * (top + shift) < 2**61
    if narrow:
        s = F.lit(sums).cast("array<bigint>")
        apart = F.transform("y", lambda y, i: (F.lit(n).cast("bigint") * y - F.element_at(s, i + 1)).cast("double") / F.lit(float(n)))
    else:
        s = F.array(*(F.lit(str(v)).cast("decimal(38,0)") for v in sums))
        apart = F.transform("y", lambda y, i: (F.lit(str(n)).cast("decimal(20,0)") * y.cast("decimal(17,0)") - F.element_at(s, i + 1)).cast("double") / F.lit(float(n)))
    covariance = gramian(rows, apart, d) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, axes = values[order], axes[:, order]
    trace = float(np.trace(covariance))
    rank = int((values > LEAST * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    explained = [max(float(e), 0.0) / trace if trace > 0 else 0.0 for e in values]
    shared = spark.sparkContext.broadcast((np.array(sums, object), axes[:, :rank] / np.sqrt(values[:rank])))
    count, missing, safe = n, [None] * (len(order) - rank), narrow and d * (2 * n * top) ** 2 < 2**63

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, axes = shared.value
        for frame in frames:
            if not len(frame):
                continue
            y = np.stack(frame["y"].to_numpy())
            apart = count * y - sums.astype(np.int64) if narrow else count * y.astype(object) - sums
            square = (apart * apart).sum(axis=1) if safe else [sum(int(v) ** 2 for v in row) for row in apart]
            out = (apart.astype(np.float64) / count) @ axes
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": [str(v) for v in square], "whitened": [[*row, *missing] for row in out.tolist()]})

    # Ids travel as text: pandas would turn a column with nulls into doubles.
    found = rows.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(project, "vec_id string, deviation string, whitened array<double>")
    held = stored(found.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened"))
    error = 0.0
    if rank:
        own = held.select(F.slice("whitened", 1, rank).alias("w"))
        mean = [s / n for s, _ in dimension_sums(own, "w")]
        middle = F.lit(mean)
        left = gramian(own, F.transform("w", lambda w, i: w - F.element_at(middle, i + 1)), rank) / n - np.eye(rank)
        error = float(np.abs(left).max())
    return Whitened(held, n, explained, error)
