"""Shared plumbing of the training-data operators.

Everything here is about execution, not about one operator's semantics: where
intermediate results are cut from their lineage, how Arrow batches are turned
into bytes, and how a caller's frame is read without caring about which other
columns it carries.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z, everything else unchanged.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results: the one that the cluster names in ``spark.checkpoint.dir``.

    All executors share it, so a lost one costs tasks and no recomputation of
    the stages before. Where the setting is absent a folder of our own is
    chosen, which is right in local mode alone; a cluster without the setting
    is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliograph-"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one job in the shared folder.

    They are written as Parquet and read again, so that lineage ends there and
    the planner knows how big they are when it chooses between sending a side
    to all tasks and shuffling both.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.place, self.tables = spark, scratch_folder(spark, "tables"), 0

    def put(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.tables += 1
        path = f"{self.place}/{self.tables}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete the tables; frames over them can no longer be read."""
        remove(self.spark, self.place)


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders of any file system that Spark knows."""
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of an Arrow batch at most, unless one row is longer; Spark's own bound is several times as much.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that workers hold few texts at a time; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    if own is None or not own.rstrip("b").isdigit() or int(own.rstrip("b")) > BATCH or int(own.rstrip("b")) <= 0:
        spark.conf.set(name, str(BATCH))


_resident: dict[Hashable, Any] = {}


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process holds for the operator at work: made once, and let go when another operator needs its own."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def windows(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes at most.

    A single longer text makes a slice of its own, so that memory follows the
    longest text and not the number of long texts that happen to be neighbours.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        sizes = lengths.to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
