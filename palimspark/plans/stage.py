"""Tables written once in the middle of a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_mine: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary one only in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _mine:
        _mine.append(tempfile.mkdtemp(prefix="palimspark-stage-"))
        atexit.register(shutil.rmtree, _mine[0], ignore_errors=True)
    return f"file://{_mine[0]}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as Parquet, read again: what several branches need is computed once, and lost executors cost no recomputation."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
