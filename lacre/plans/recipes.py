"""Texts made from the keys of a table, by expressions that Spark and DuckDB read alike.

A recipe is a list of (name, expression) over ``k``; each may use those before it. The same recipe
makes the text that a detector is run on and, in SQL, what it must find there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Recipe = Sequence[tuple[str, str]]
#: Keys of one task: detection took 0.3 ms of a core for each, so a task stays short however large the table is.
TASK_KEYS = 50_000
#: Rows of one task that are sorted and joined: pages_with_entities took 680 MB for them, at 6 and at 60 times sf0.1.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys in tasks of about ``rows`` rows: their number follows the input, their size does not."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def in_spark(spark: SparkSession, sf_dir: str, recipe: Recipe) -> DataFrame:
    # The keys are spread before anything is made of them: a small file is one split, whatever work hangs on it.
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k")
    df = dealt(keys, TASK_KEYS, "k")
    for name, expression in recipe:
        # A generator of one row keeps the optimizer from writing each step out wherever it is used.
        df = df.select("*", F.explode_outer(F.array(F.expr(expression))).alias(name))
    return df


def in_sql(recipe: Recipe, then: str) -> str:
    """``then`` reads the recipe's rows from ``made``."""
    steps = ["made0 AS (SELECT o_orderkey AS k FROM orders)"]
    for i, (name, expression) in enumerate(recipe):
        steps.append(f"made{i + 1} AS (SELECT *, {expression} AS {name} FROM made{i})")
    return f"WITH {', '.join(steps)}, made AS (SELECT * FROM made{len(recipe)}) {then}"


def padded(expression: str, size: int) -> str:
    return f"lpad(CAST({expression} AS VARCHAR(40)), {size}, '0')"


def digit(d: str, i: int) -> str:
    return f"CAST(substr({d}, {i}, 1) AS INT)"


def total(d: str, weights: Sequence[int], first: int = 1) -> str:
    return "(" + " + ".join(f"{digit(d, i)} * {w}" for i, w in enumerate(weights, first)) + ")"


def mod11(d: str, weights: Sequence[int]) -> str:
    rest = f"({total(d, weights)} % 11)"
    return f"(CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END)"


def same(d: str) -> str:
    return f"({d} = repeat(substr({d}, 1, 1), CAST(length({d}) AS INT)))"


def cpf(d: str) -> str:
    return f"(NOT {same(d)} AND {digit(d, 10)} = {mod11(d, range(10, 1, -1))} AND {digit(d, 11)} = {mod11(d, range(11, 1, -1))})"


CNPJ = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
PIS = (3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def cnpj(d: str) -> str:
    return f"(NOT {same(d)} AND {digit(d, 13)} = {mod11(d, CNPJ[1:])} AND {digit(d, 14)} = {mod11(d, CNPJ)})"


def pis(d: str) -> str:
    return f"(NOT {same(d)} AND {digit(d, 11)} = {mod11(d, PIS)})"


def cnh(d: str) -> str:
    rest = f"({total(d, range(9, 0, -1))} % 11)"
    other = f"(({total(d, range(1, 10))} % 11 - CASE WHEN {rest} >= 10 THEN 2 ELSE 0 END + 11) % 11)"
    return f"(NOT {same(d)} AND {digit(d, 10)} = CASE WHEN {rest} >= 10 THEN 0 ELSE {rest} END AND {digit(d, 11)} = CASE WHEN {other} >= 10 THEN 0 ELSE {other} END)"


def titulo(d: str) -> str:
    state = f"CAST(substr({d}, 9, 2) AS INT)"

    def dv(t: str) -> str:
        return f"(CASE WHEN {t} % 11 = 0 THEN CASE WHEN {state} IN (1, 2) THEN 1 ELSE 0 END WHEN {t} % 11 = 10 THEN 0 ELSE {t} % 11 END)"

    second = f"({digit(d, 9)} * 7 + {digit(d, 10)} * 8 + {digit(d, 11)} * 9)"
    return f"({state} BETWEEN 1 AND 28 AND {digit(d, 11)} = {dv(total(d, range(2, 10)))} AND {digit(d, 12)} = {dv(second)})"


def cns(d: str) -> str:
    t = total(d, range(15, 4, -1))
    plain, moved = f"(11 - {t} % 11)", f"(11 - ({t} + 2) % 11)"
    tail = f"CASE WHEN {plain} = 10 THEN '001' || CAST({moved} AS VARCHAR(2)) WHEN {plain} = 11 THEN '0000' ELSE '000' || CAST({plain} AS VARCHAR(2)) END"
    return f"(CASE WHEN substr({d}, 1, 1) IN ('1', '2') THEN substr({d}, 12, 4) = {tail} WHEN substr({d}, 1, 1) IN ('7', '8', '9') THEN {total(d, range(15, 0, -1))} % 11 = 0 ELSE false END)"


def cnj(d: str) -> str:
    """The remainder by 97 in three steps of nine digits or fewer."""
    first = f"(CAST(substr({d}, 1, 7) AS BIGINT) % 97)"
    second = f"(({first} * 1000000 + CAST(substr({d}, 10, 6) AS BIGINT)) % 97)"
    third = f"(({second} * 10000000 + CAST(substr({d}, 16, 5) AS BIGINT) * 100) % 97)"
    return f"(98 - {third} = CAST(substr({d}, 8, 2) AS BIGINT))"


def luhn(d: str, size: int) -> str:
    parts = []
    for i in range(size, 0, -1):
        x = digit(d, i)
        parts.append(x if (size - i) % 2 == 0 else f"(CASE WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END)")
    return f"(({' + '.join(parts)}) % 10 = 0)"
