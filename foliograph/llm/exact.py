"""Exact duplicates through content-defined chunk recipes.

Every text is cut where a rolling hash of its last bytes has a given form, so
equal passages are cut alike wherever they stand. A chunk's digest becomes its
identifier once it is verified: the distinct contents behind each digest are
brought together, each content once per task and not once per occurrence, and
where a digest has several contents they stand for themselves. A text is then its
recipe, the ordered list of chunk identifiers; texts are equal exactly when
their recipes are, and only recipes, not texts, are compared and moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import cut, small_batches, table, text_bytes, windows

#: Bytes that decide a cut; cuts come every 2 ** CUT_BITS bytes on average, and LEAST and MOST bound a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 11, 512, 16_384
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_STEP = 0x01000193


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length, the empty text has none."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    value, power = _GEAR[np.frombuffer(data, np.uint8)], _STEP
    reach = 1
    while reach < WINDOW:  # doubles the number of bytes behind each value
        wider = value.copy()
        wider[reach:] += value[:-reach] * np.uint32(power)
        value, power, reach = wider, power * power & 0xFFFFFFFF, reach * 2
    good = (np.flatnonzero(value >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, start = [], 0
    for end in [*good, n]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST or end == n and end > start:
            ends.append(end)
            start = end
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def digest(chunk: bytes) -> bytes:
    """128 bits that name a chunk."""
    return hashlib.blake2b(chunk, digest_size=16).digest()


Digest = Callable[[bytes], bytes]


def chunk_rows(docs: DataFrame, text_col: str, named: Digest) -> DataFrame:
    """(name, content): the distinct chunks of each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows(batches, "body"):
            own = {c for body in batch.column(0).to_pylist() for c in chunks(body)}
            if own:
                content = sorted(own)
                yield pa.RecordBatch.from_arrays([pa.array(map(named, content), pa.binary()), pa.array(content, pa.binary())], ["name", "content"])

    return docs.select(text_bytes(text_col).alias("body")).mapInArrow(run, "name binary, content binary")


def clashes(docs: DataFrame, text_col: str = "text", named: Digest = digest) -> DataFrame:
    """(name): the digests with several contents; none verifies every digest as the identifier of one content."""
    distinct = chunk_rows(docs, text_col, named).groupBy("name", "content").agg(F.count(F.lit(1)).alias("n"))
    return cut(distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", named: Digest = digest, most: int = 100_000) -> DataFrame:
    """(doc_id, text_sha256, recipe): recipe is the text's ordered identifiers, joined.

    A verified digest identifies its chunk. Where a digest has several contents
    the content itself is the identifier, so recipes are equal for equal texts
    alone. More than ``most`` such digests are refused: 128 bits have none in
    practice, so the function would be at fault.
    """
    small_batches(docs.sparkSession)
    doubtful = frozenset(bytes(r[0]) for r in clashes(docs, text_col, named).limit(most + 1).collect())
    if len(doubtful) > most:
        raise ValueError(f"more than {most} digests have several contents")

    def identifier(chunk: bytes) -> bytes:
        name = named(chunk)
        return b"\1" + len(chunk).to_bytes(4) + chunk if name in doubtful else b"\0" + name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows(batches, "body"):
            bodies = batch.column(1).to_pylist()
            lists = [b"".join(map(identifier, chunks(body))) for body in bodies]
            sums = [hashlib.sha256(body).hexdigest() for body in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums), pa.array(lists, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, text_sha256 string, recipe binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, named: Digest = digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null is the empty text, whose recipe is empty. Of equal texts the row with
    the largest id stays; a null id stays only where its group has no other,
    and repeated rows with the largest id are all reported as kept, for they
    name the same document. Groups are counted with map-side combine, and a
    group's name goes back to its rows over ``salts`` parts, so a text with
    copies in a third of the table loads no single task. Texts of any length are
    read whole; an empty table gives no row; other columns are not looked at.
    """
    rows = cut(recipes(docs, id_col, text_col, named))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = groups.filter("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    joined = salted.join(several, ["recipe", "salt"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document with the row that stays of its equal texts."""
    return exact_duplicates(table(spark, sf_dir, "documents"))
