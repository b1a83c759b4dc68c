"""Intermediate tables that survive lost executors, written to the folder that ``spark.checkpoint.dir`` names, and batches
of bounded size for what runs in Python."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
BATCH_BYTES = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode without the setting a temporary one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="signalmill-engine-"))
    return _OWN[0]


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` at most: rows are whole texts or blocks of vectors, so a number of rows bounds
    nothing.

    The session's limit is lowered once and stays; results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back: lineage ends there."""
    bound_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
