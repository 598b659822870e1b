"""Token ids packed into fixed-length rows by best-fit decreasing over the whole corpus.

Documents are tokenized whole, each ended by a separator id. A document longer
than a row is split into full rows and a rest; nothing is dropped. The pieces
are placed in decreasing order, each into the fullest row that still holds it,
which a segment tree over the free lengths finds.

Best-fit decreasing looks at lengths alone, and pieces of one length are alike.
So the corpus is planned from its counts by length: rows with equal free length
are intervals of row numbers, and all pieces of a length go into intervals at a
time, as they would one after the other. The plan has an entry for each length
and interval, at most about the square of the row length and in practice a few
thousand, however many documents there are. Pieces are numbered within their
length in parts of bounded size, looked up in the plan, and gathered by row.

Rows come out as an id matrix, with the cumulative lengths of their segments
and the positions at which position ids start again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import Scratch, small_batches, table, text_bytes, windows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW, SEPARATOR = 2048, 50_256
#: Number of the first pack of rows that one piece fills.
FULL = 1 << 52
#: Long runs of white space, which the pattern's look-ahead would walk by recursion.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]{4096,}")


@lru_cache(maxsize=2)
def tokenizer(vocabulary: bytes, pattern: str):  # type: ignore[no-untyped-def]
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(encoding, text: str) -> list[int]:  # type: ignore[no-untyped-def]
    """Ids of a text of any form.

    Of a run of white space the pattern takes all but the last character as one
    word, and the last one too at the end of the text. Long runs are cut out
    there and merged without the pattern, so the ids are those of the whole.
    """
    ids, at = [], 0
    for run in _SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


class Free:
    """Segment tree over free lengths 0..top: which intervals of rows have how much left."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def _add(self, length: int, n: int) -> None:
        at = self.size + length
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, length: int, first: int, n: int) -> None:
        """Rows ``first`` to ``first + n - 1`` have ``length`` left."""
        if n:
            self.rows[length].append((first, n))
            self._add(length, 1)

    def take(self, length: int) -> tuple[int, int, int] | None:
        """(free length, first row, rows) with the least free length that is at least ``length``, removed; None without one."""
        at, count = self.size + length, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.size
        self._add(free, -1)
        return free, *self.rows[free].pop()


class Step(NamedTuple):
    """Pieces ``first``.. of a length go into rows from ``row``, ``each`` of them in a row, side by side from ``offset``."""

    length: int
    first: int
    each: int
    row: int
    offset: int


def best_fit(counts: dict[int, int], row: int) -> tuple[list[Step], int]:
    """(steps, number of rows) of best-fit decreasing for so many pieces of each length, ordered by (length, first)."""
    free, steps, opened = Free(row), [], 0
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            found = free.take(length)
            if found is None:
                found = row, opened, -(-left // (row // length))
                opened += found[2]
            room, first, rows = found
            # the fullest row stays the fullest until no piece of this length fits into it
            each = room // length
            whole = min(rows, left // each)
            steps.append(Step(length, done, each, first, row - room))
            done, left = done + whole * each, left - whole * each
            free.put(room - each * length, first, whole)
            if whole < rows and left and left < each:
                free.put(room - left * length, first + whole, 1)
                done, left, whole = done + left, 0, whole + 1
            free.put(room, first + whole, rows - whole)
    return sorted(steps), opened


def pieces(docs: DataFrame, row: int, vocabulary: bytes, pattern: str, separator: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, start, n, ids): a number for each input row, and its ids in pieces of at most ``row``."""
    kind = np.dtype("<u2" if separator < 1 << 16 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file of a few MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(shared.value, pattern)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in windows(batches, "body", 2 << 20):
            out = []
            for doc, doc_id, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([*encode(encoding, body.decode("utf-8", "replace")), separator], kind)
                out += [(doc, doc_id, at, len(ids[at : at + row]), ids[at : at + row].tobytes()) for at in range(0, len(ids), row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "doc_id", "start", "n", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc long, doc_id long, start long, n int, ids binary")


def pack(
    docs: DataFrame, row: int = ROW, path: str = VOCABULARY, pattern: str = PATTERN, separator: int = SEPARATOR, pack_rows: int = 1024, slices: int = 65_536, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each packed row: pack, row, ids, cu_seqlens, resets, docs, doc_ids, starts.

    ``ids`` are ``row`` little-endian unsigned 16-bit integers (32-bit where the
    separator does not fit), padded with the separator; ``cu_seqlens`` are the
    cumulative segment lengths from 0, ``resets`` the positions in the row at
    which position ids start again; ``docs`` number the input row that a segment
    comes from, ``doc_ids`` and ``starts`` name its document and its first
    token's place in it. A pack is at most ``pack_rows`` rows, which bounds a
    matrix. Pieces as long as a row fill one and are not moved; their packs are
    numbered from ``FULL`` on, by the partition that they lie in.

    Null and empty texts are a lone separator; rows with null or repeated ids
    are packed like any other; texts may have any length and any run of white
    space; an empty table gives no row. Which of the pieces of one length comes
    first follows from the order in which the table is read; the lengths in each
    row do not.

    A length is numbered in parts, and gets as many of the ``slices`` as its
    share of all pieces asks for, so no task sorts a hot length alone. The
    driver sees two counts at most for each slice and length.
    """
    spark = docs.sparkSession
    with open(path, "rb") as file:
        vocabulary = file.read()
    every = Scratch(spark).put(pieces(docs, row, vocabulary, pattern, separator, id_col, text_col), compression="zstd")
    held = every.filter(F.col("n") < row)
    counts = {r["n"]: r["count"] for r in held.groupBy("n").count().collect()}
    total = max(sum(counts.values()), 1)
    steps, rows = best_fit(counts, row)
    of = np.array(steps, np.int64).reshape(-1, len(Step._fields))
    plan = spark.sparkContext.broadcast(of)  # bounded by the row length, as said above
    parts = spark.createDataFrame([(n, -(-c * slices // total)) for n, c in counts.items()], "n int, parts int")
    dealt = held.join(F.broadcast(parts), "n").withColumn("part", F.pmod(F.xxhash64("doc", "start"), F.col("parts")).cast("int")).drop("parts")
    ahead, starts = dict.fromkeys(counts, 0), []
    for n, part, own in sorted(map(tuple, dealt.groupBy("n", "part").count().collect())):
        starts.append((n, part, ahead[n]))
        ahead[n] += own
    before = spark.createDataFrame(starts, "n int, part int, before long")
    within = F.row_number().over(Window.partitionBy("n", "part").orderBy("doc", "start")) - 1
    ranked = dealt.join(F.broadcast(before), ["n", "part"]).withColumn("rank", F.col("before") + within)

    @F.pandas_udf("row long, offset int")
    def place(lengths, ranks):  # type: ignore[no-untyped-def]
        import pandas as pd

        length, rank, steps = lengths.to_numpy().astype(np.int64), ranks.to_numpy(), plan.value
        # steps are in order of (length, first); ranks of a length stay below 2 ** 40
        at = np.searchsorted((steps[:, 0] << 40) + steps[:, 1], (length << 40) + rank, "right") - 1
        _, first, each, row, offset = steps[at].T
        return pd.DataFrame({"row": row + (rank - first) // each, "offset": (offset + (rank - first) % each * length).astype(np.int32)})

    placed = ranked.withColumn("at", place("n", "rank"))
    segment = F.struct(F.col("at.offset").alias("offset"), "doc", "doc_id", "start", "n", "ids")
    # a row holds at most ``row`` ids, so a group is small whatever the corpus
    gathered = placed.groupBy(F.col("at.row").alias("number")).agg(F.array_sort(F.collect_list(segment)).alias("own"))
    kind = np.dtype("<u2" if separator < 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padding = np.full(row, separator, kind).tobytes()
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in batches:
            out = []
            for number, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.cumsum([s["n"] for s in own]).tolist()
                ids = b"".join(s["ids"] for s in own)
                names = ([s[k] for s in own] for k in ("doc", "doc_id", "start"))
                out.append((number // pack_rows, number % pack_rows, ids + padding[len(ids) :], [0, *ends], [0, *ends[:-1]], *names))
            kinds = [pa.int64(), pa.int32(), pa.binary(), ints, ints, longs, longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["pack", "row", "ids", "cu_seqlens", "resets", "docs", "doc_ids", "starts"])

    schema = "pack long, row int, ids binary, cu_seqlens array<int>, resets array<int>, docs array<long>, doc_ids array<long>, starts array<long>"
    number, ends, zero = F.monotonically_increasing_id(), F.array(F.lit(0), F.lit(row)), F.array(F.lit(0))
    full = every.filter(F.col("n") == row).withColumn("number", number)
    part, place_in = F.shiftright("number", 33), F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    full = full.select(
        (F.lit(FULL) + F.shiftleft(part, 24) + F.floor(place_in / pack_rows)).cast("long").alias("pack"), (place_in % pack_rows).cast("int").alias("row"), "ids", ends.alias("cu_seqlens"), zero.alias("resets"),
        F.array("doc").alias("docs"), F.array("doc_id").alias("doc_ids"), F.array("start").alias("starts"),
    )
    return gathered.mapInArrow(run, schema).unionByName(full)


def unpack(rows: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, separator: int = SEPARATOR) -> DataFrame:
    """(doc, doc_id, text) from packed rows: the inverse of ``pack``, a row for each of its input rows, repeated and null ids included."""
    kind = np.dtype("<u2" if separator < 1 << 16 else "<u4")
    with open(path, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def joined(parts):  # type: ignore[no-untyped-def]
        import pandas as pd

        encoding = tokenizer(shared.value, pattern)
        return pd.Series([encoding.decode(np.frombuffer(b"".join(bytes(x) for x in own), kind)[:-1].tolist()) for own in parts])

    n = F.lit(kind.itemsize)
    each = rows.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("docs", "doc_ids", "starts")).alias("k", "s"))
    first, last = F.col("cu_seqlens")[F.col("k")], F.col("cu_seqlens")[F.col("k") + 1]
    each = each.select(F.col("s.docs").alias("doc"), F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), F.substring("ids", first * n + 1, (last - first) * n).alias("part"))
    whole = each.groupBy("doc", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("own"))
    return whole.select("doc", "doc_id", joined(F.transform("own", lambda s: s["part"])).alias("text"))


def matrices(rows: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(pack, rows, width, ids, cu_seqlens, position_ids): one row for each pack, ready to be mapped into memory.

    ``ids`` is the row-major id matrix. ``cu_seqlens`` are little-endian 32-bit
    cumulative segment lengths over the whole matrix, from 0 to its size, where
    the padding of a row is a segment of its own; ``position_ids`` has for each
    id its 32-bit place in its segment. A pack is bounded, so one call holds it.
    """
    kind = np.dtype("<u2" if separator < 1 << 16 else "<u4")
    schema = "rows int, width int, ids binary, cu_seqlens binary, position_ids binary"

    def build(own) -> tuple[int, int, bytes, bytes, bytes]:  # type: ignore[no-untyped-def]
        ids = b"".join(bytes(r["ids"]) for r in own)
        width = len(ids) // kind.itemsize // len(own)
        ends = [np.append(np.asarray(r["cu_seqlens"][1:]), width) + i * width for i, r in enumerate(own)]
        cumulative = np.unique(np.concatenate([[0], *ends])).astype("<i4")
        positions = np.arange(width * len(own)) - np.repeat(cumulative[:-1], np.diff(cumulative))
        return len(own), width, ids, cumulative.tobytes(), positions.astype("<i4").tobytes()

    @F.pandas_udf(schema)
    def made(packs):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.DataFrame([build(own) for own in packs], columns=["rows", "width", "ids", "cu_seqlens", "position_ids"])

    whole = rows.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("row", "ids", "cu_seqlens"))).alias("own"))
    return whole.select("pack", made("own").alias("m")).select("pack", "m.*")


def write_binary(rows: DataFrame, path: str) -> None:
    """The matrices of all packs as uncompressed Parquet binaries, which Spark's writers commit task by task."""
    matrices(rows).write.option("compression", "uncompressed").parquet(path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every packed row of all documents."""
    return pack(table(spark, sf_dir, "documents"))
