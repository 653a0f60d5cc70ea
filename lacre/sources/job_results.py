"""Results of jobs as files, one document a job, by a data source that commits a whole write at once.

Each attempt of a task writes into a folder of its own under ``.staging``; when all tasks are done the
folders of the attempts that counted become one folder of the run, by one rename, and what other
attempts left goes. A write that fails leaves nothing. A run never touches what earlier runs wrote; of
a job that was written several times the last run's document counts.

    register(spark)
    results.write.format("job_results").mode("append").save(folder)
    stored(spark, folder)
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import shared, ship
from .word_tables import opened

STAGING = ".staging"
#: How often a deletion is tried, and the seconds between two tries.
TRIES, PAUSE = 5, 0.1
OUTCOME = "id string, path string, removed boolean, erro string"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    documents: int


class JobResultsWriter(DataSourceWriter):
    """Takes rows of (id, resultado)."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        # Runs sort by the time at which they began.
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator) -> Attempt:
        task = TaskContext.get()
        system, base = opened(self.path)
        folder = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        place = f"{base}/{STAGING}/{self.run}/{folder}"
        system.create_dir(place, recursive=True)
        n = 0
        for row in iterator:
            name = row["id"]
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"no id of a job: {name!r}")
            with system.open_output_stream(f"{place}/{name}.json") as out:
                out.write(row["resultado"].encode())
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list) -> None:
        system, base = opened(self.path)
        kept = {m.folder for m in messages if m is not None and m.documents}
        staged = f"{base}/{STAGING}/{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            for info in system.get_file_info(fs.FileSelector(staged)):
                if info.base_name not in kept:
                    system.delete_dir(info.path)
            if kept:
                system.move(staged, f"{base}/run={self.run}")
        self.cleared(system, base)

    def abort(self, messages: list) -> None:
        system, base = opened(self.path)
        self.cleared(system, base)

    def cleared(self, system: fs.FileSystem, base: str) -> None:
        staged = f"{base}/{STAGING}/{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class JobResults(DataSource):
    """``write.format("job_results").mode("append")``."""

    @classmethod
    def name(cls) -> str:
        return "job_results"

    def schema(self) -> str:
        return "id string, resultado string"

    def writer(self, schema, overwrite: bool) -> JobResultsWriter:
        if overwrite:
            raise ValueError("job_results only appends: earlier runs stay")
        return JobResultsWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(JobResults)


def last_run(files: DataFrame) -> DataFrame:
    """The files (path, ...) of the last run of each job, with id and run."""
    own = files.withColumns({"id": F.regexp_extract("path", r"/([^/]+)\.json$", 1), "run": F.regexp_extract("path", r"/run=([^/]+)/", 1)}).where("run <> ''")
    return own.join(own.groupBy("id").agg(F.max("run").alias("run")), ["id", "run"])


def stored(spark: SparkSession, path: str) -> DataFrame:
    """id, run, path and ``resultado`` of each job, from the last run that wrote it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return last_run(files.select(F.input_file_name().alias("path"), F.col("value").alias("resultado")))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """id, run, path and length of all documents, of earlier runs as well; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).select("path", "length")
    return files.select(F.regexp_extract("path", r"/([^/]+)\.json$", 1).alias("id"), F.regexp_extract("path", r"/run=([^/]+)/", 1).alias("run"), "path", "length").where("run <> ''")


def purge(doomed: DataFrame) -> DataFrame:
    """Delete the files of ``doomed`` (id, path) in tasks: a row for each, removed or with its error.

    A file that is gone already counts as removed, so a purge may be run again: what could not be
    deleted is taken up then. The list is stored before the first file goes, and the outcomes are
    stored as well, so that a task that is run again finds what it had to do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = [failure(path) for path in batch["path"]]
            yield pd.DataFrame({"id": batch["id"], "path": batch["path"], "removed": [e is None for e in errors], "erro": errors})

    held = shared(doomed.select(F.col("id").cast("string").alias("id"), "path"))
    return shared(held.mapInPandas(run, OUTCOME))


def failure(path: str) -> str | None:
    """Why a file could not be deleted, or null."""
    error: Exception | None = None
    for k in range(TRIES):
        try:
            system, name = opened(path)
            kind = system.get_file_info(name).type
            if kind == fs.FileType.NotFound:
                return None
            (system.delete_dir if kind == fs.FileType.Directory else system.delete_file)(name)
            return None
        except (OSError, pa.ArrowException) as now:
            error = now
            if k < TRIES - 1:
                time.sleep(PAUSE)
    return f"{type(error).__name__}: {error}"
