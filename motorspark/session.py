"""Spark session for local runs, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the job's own session is used."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("motorspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MOTORSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's reliable checkpoint folder and read it from there.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a session that has
    none, such as a local test, gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="motorspark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
