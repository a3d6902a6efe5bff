"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="gaugeworks-")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; only a local master may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or _temporary()}/gaugeworks-files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new shared folder and go on from that copy: lineage ends there, and Spark knows its size."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
