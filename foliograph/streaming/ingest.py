"""Documents as a stream. Not an operation of the document model: an extension for files that keep arriving.

The same parsers and aggregations run over micro-batches; late and repeated
files are handled by a watermark on their time of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from foliograph.sources.packages import decode


def packages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Decoded packages of a folder, file by file as they arrive, each path once within two days."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return decode(files.withWatermark("modificationTime", "2 days").dropDuplicatesWithinWatermark(["path"]))


def activity(events: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of a record stream by kind and time window, closed when ``late`` has passed."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), kind, "n", "total")
    )


def append(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended as Parquet; a broken run goes on where it stopped."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
