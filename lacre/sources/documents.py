"""Documents as rows: whole text files, uploads with their checks, tables, and pages by a parser of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest upload and how a PDF begins.
MOST_BYTES = 50 << 20
PDF_MAGIC = b"%PDF-"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of each file, line ends as they are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def table(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """A Parquet table with a text column of that name."""
    return spark.read.parquet(path).withColumnRenamed(text, "text")


def refusal(content: Column, length: Column, most_bytes: int = MOST_BYTES, magic: bytes = PDF_MAGIC) -> Column:
    """Null for what is taken, 413 for what is too long, else 415 for what does not begin as it has to."""
    starts = F.hex(F.substring(content, 1, len(magic))) == magic.hex().upper()
    return F.when(length > most_bytes, 413).when(~F.coalesce(starts, F.lit(False)), 415)


def uploads(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length, content and ``recusa``: null for a PDF within the limit, else 413 or 415. Empty files are no rows: the reader lists none."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.withColumn("recusa", refusal(F.col("content"), F.col("length"), most_bytes))


def parsed(files: DataFrame, parser: Callable[[bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``parser`` makes of each file (``content``), with the path as doc_id.

    No PDF or OCR library comes with this one: the parser is the user's, and gives glyphs or words as
    the layout operators take them. A file it cannot read becomes no row but an ``erro``.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [{"doc_id": path, "erro": None, **row} for row in parser(bytes(content))]
                except Exception as error:  # noqa: BLE001  a bad file is data, and must not end the job
                    rows.append({"doc_id": path, "erro": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=["doc_id", "erro", *names], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"doc_id string, erro string, {schema}")
