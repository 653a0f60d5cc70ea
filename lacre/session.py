"""What jobs share: this package on the executors, and a folder that all of them see."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session: without effect where executors have the package already."""
    sc = spark.sparkContext
    if getattr(sc, "_lacre_shipped", None):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lacre-code-"), "lacre_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lacre", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._lacre_shipped = path


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the one that ``spark.checkpoint.dir`` names.

    Only a local session without one gets a temporary folder; on a cluster no executor would see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lacre-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def shared(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without the plan that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
