"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that several plans read, once, to the folder in `spark.checkpoint.dir` (a folder of this machine
    only where none is set and Spark runs on it alone), and reads it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='sensorloom-')}")
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
