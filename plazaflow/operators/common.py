"""Materialisation of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder is made only where none is set and all tasks run in the driver's process.

    A cluster without it is an error, as its machines share no folder of ours.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plazaflow-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Computes a table once into the reliable checkpoint folder (:func:`shared_folder`), which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
