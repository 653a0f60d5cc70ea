"""The operators' queries against their SQL in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lacre.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "embeddings")


def same(found, name, paths):
    con = duckdb.connect()
    for table, path in paths.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    wanted = con.execute(SQL[name])
    columns = sorted(d[0] for d in wanted.description)
    order = [[d[0] for d in wanted.description].index(c) for c in columns]
    rows = sorted(repr([r[i] for i in order]) for r in wanted.fetchall())
    assert columns == sorted(found.columns)
    assert sorted(repr(list(r)) for r in found.select(*columns).collect()) == rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_standard_tables(spark, name):
    same(QUERIES[name](spark, SF_DIR), name, {t: f"{SF_DIR}/{t}.parquet" for t in TABLES})


@pytest.mark.parametrize("name", sorted(SQL))
def test_nulls_ties_and_repeats(spark, documents, benchmark, tmp_path, name):
    texts = documents.withColumn("text", F.when(F.col("doc_id") == 12, F.concat("text", F.lit("\x0b\x1f\x00\xa0 É\U0001f600 end"))).otherwise(F.col("text")))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = [(i, [((i * k) % 7 - 3) / 9.0 for k in range(1, 5)], "x") for i in range(90)]
    vectors += [vectors[20], vectors[21], (None, [1.0] * 4, "x"), (200, None, None), (220, [1.0, None, 0.0, 0.0], "x"), (240, [float("nan")] * 4, "x"), (260, [float("inf"), 0.0, 0.0, 0.0], "x"), (-20, [-0.01, 0.0, 0.3, 0.0], "x")]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, v string").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(QUERIES[name](spark, str(tmp_path)), name, {t: f"{tmp_path}/{t}.parquet/*.parquet" for t in TABLES})
