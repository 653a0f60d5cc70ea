"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. The first four
return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.llm.common import DOC_COLUMNS, prepare, table
from lacre.llm.decontaminate import decontaminated
from lacre.llm.langid import identified
from lacre.llm.linedup import without_repeated_lines
from lacre.llm.packing import pack
from lacre.llm.simhash import near_unique


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language has at least half of the letters."""
    return identified(docs, DOC_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that, up to two edits, stand in an earlier document or place."""
    return without_repeated_lines(docs, DOC_COLUMNS, of_files=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return near_unique(docs, DOC_COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is text of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), DOC_COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", lambda spark, docs, sf_dir: language(prepare(spark), docs, sf_dir)),
    ("line dedup", lambda spark, docs, sf_dir: lines(prepare(spark), docs, sf_dir)),
    ("SimHash near-dedup", lambda spark, docs, sf_dir: near_copies(prepare(spark), docs, sf_dir)),
    ("benchmark decontamination", lambda spark, docs, sf_dir: benchmarks(prepare(spark), docs, sf_dir)),
    ("packing", lambda spark, docs, sf_dir: sequences(prepare(spark), docs, sf_dir)),
]

#: Edit joins, fingerprints and tokens are beyond SQL; tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again; the last one's folder stays."""
    prepare(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs


def removed(spark: SparkSession, path: str) -> None:
    """Delete what a stage has written once the next one is written: the last one's alone stays."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
