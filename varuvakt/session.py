"""Session settings the library expects, and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Time zone is part of the semantics (UTC days, millisecond conversion); the
# rest are plan-quality settings a cluster may override.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where the aggregation above it then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole documents or files: what a Python worker holds at a time is bounded by bytes, not only by a count of rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app: str = "varuvakt", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Put the settings on a session someone else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for data that several executors write and read, under ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may leave
    the setting out; a temporary folder is used then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="varuvakt-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` stored in the shared folder and read back.

    Cuts the lineage, so a result with side effects or a high price is computed
    once, whatever is derived from it and whichever executors are lost.
    """
    location = shared_dir(df.sparkSession, purpose)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
