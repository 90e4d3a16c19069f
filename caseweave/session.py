"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def local_session(app: str = "caseweave", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CASEWEAVE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``; a session without one is refused."""
    configured = _scratch.get() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Keep what operators write inside the block in a new folder of its own, and remove that folder at its end.

    Results must be written or collected inside the block.
    """
    context, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    folder = new_table_path(spark, "scratch")
    token = _scratch.set(folder)
    context.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        # The folder of a context already has a name of its own, and a new one is made below it.
        context.setCheckpointDir(before or shared_folder(spark))
        system, path = fs.FileSystem.from_uri(folder)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


def pin(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep the rows in the shared folder, so every later use sees the same ones."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_table_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` once to the shared folder and read it from there, with the number of rows that were written.

    Later uses see the same rows, and read only the columns they need. The rows are counted by the write itself.
    """
    path, rows = new_table_path(df.sparkSession, "stored"), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows.get["rows"]
