"""Text slots of a section and patches that keep everything else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.rules import patch_guard


def slots(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """The text of each paragraph as a slot: its path and hash."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    path = F.concat(F.lit("paragraphs["), n.cast("string"), F.lit("].runs[0].text"))
    return rows.select(*keys, path.alias("path"), F.sha2(F.col(text).cast("binary"), 256).alias("hash"), F.col(text).alias("text"))


def guarded(base: DataFrame, new: DataFrame, on: Sequence[str], text: str, expected: DataFrame | None = None) -> DataFrame:
    """Base and new slots side by side, with what refuses the change of each.

    ``expected`` has the hashes that the base had when it was exported; without
    it the base is taken as unchanged.
    """
    path = F.concat_ws("/", *[F.col(c).cast("string") for c in on])
    a = base.select(*on, path.alias("path_base"), F.col(text).alias("text_base"), F.sha2(F.col(text).cast("binary"), 256).alias("hash_base"))
    b = new.select(*on, path.alias("path_new"), F.col(text).alias("text_new"))
    both = a.join(b, list(on), "full_outer")
    both = both.join(expected, list(on), "left") if expected is not None else both.withColumn("hash_expected", F.col("hash_base"))
    return patch_guard(both)


def apply(checked: DataFrame) -> DataFrame:
    """Text after the patch: the new one where nothing refuses it."""
    return checked.withColumn("text", F.when(F.col("refused").isNull() & F.col("changed"), F.col("text_new")).otherwise(F.col("text_base")))


def redact(rows: DataFrame, text: str) -> DataFrame:
    """Rows without their texts, to compare structure alone."""
    return rows.withColumn(text, F.lit(""))
