"""What the corpus operators share: the shared folder, code shipping and bounded text slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import shared_folder, ship

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SLICE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a session and make sure checkpoint() has a folder that all share."""
    ship(spark)
    shared_folder(spark)
    return spark


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, without the plan that made them."""
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, of_files: bool = False) -> DataFrame:
    """``df`` with ``_row``, which tells rows apart and stays the same however often a task is run again.

    The caller says with ``of_files`` that each row is a row of a file, once: then it is the row's place.
    Any other table, in which a row of a file may have become several, is written to the shared folder
    first, as its rows may come in another order when a lost executor's work is done once more.
    """
    if of_files:
        try:
            placed = df.withColumn("_row", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
            placed.schema
            return placed
        except AnalysisException:
            pass  # a table made in memory has no files
    return stored(df.withColumn("_row", F.monotonically_increasing_id()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(col))), F.lit(0))).first()[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def schema_with(df: DataFrame, keep: tuple[str, ...], extra: str) -> str:
    """DDL of the kept columns followed by ``extra``."""
    types = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in keep), extra])


def carried(batch: pa.RecordBatch, keep: tuple[str, ...], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + list(extra.values()), names=[*keep, *extra])
