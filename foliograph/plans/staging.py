"""Intermediate rows that a job needs more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the place that the cluster names in ``spark.checkpoint.dir``; of our own in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='foliograph-')}/rows-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows written once and read again, each reader taking the columns that it needs."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
