"""Uploads taken in as a stream of files: each one once, as a job or as a refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.documents import MOST_BYTES, refusal

FILES = "path string, modificationTime timestamp, length bigint, content binary"
COLUMNS = ("id", "ts", "seq", "event", "path", "length", "sha256", "recusa")


def as_jobs(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A job's first event for each file that is taken, ``event`` null for one that is refused; the content stays where it is.

    The id follows from the path and the time of writing, so that a file taken twice is one job, and a
    file that is replaced another.
    """
    why = refusal(F.col("content"), F.col("length"), most_bytes)
    name = F.md5(F.concat_ws("\n", "path", F.unix_micros("modificationTime").cast("string")))
    found = files.withColumns({"recusa": why, "id": name, "ts": F.col("modificationTime"), "seq": F.lit(0).cast("bigint"), "sha256": F.sha2("content", 256)})
    return found.withColumn("event", F.when(F.col("recusa").isNull(), F.lit("created"))).select(*COLUMNS)


def take_in(spark: SparkSession, uploads: str, jobs: str, checkpoint: str, most_bytes: int = MOST_BYTES, **trigger) -> StreamingQuery:
    """Follow a folder of uploads; ``jobs`` gets a Parquet folder for each batch, ``trigger`` is the stream's (all there is by default).

    A batch that is run again after a failure has the same number and the same files, and replaces its
    own folder, so each file is a row once.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").load(uploads)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{jobs}/batch={number}")

    stream = as_jobs(files, most_bytes).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
