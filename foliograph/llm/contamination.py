"""Benchmark decontamination by greedy string tiling.

A document leaks a test item when non-overlapping common passages ("tiles")
cover enough of the item, in whatever order they stand. Tiles are found by the
running Karp-Rabin form of greedy string tiling: rolling hashes of windows of a
search length over the unmarked tokens of both sides give candidates, these are
extended and checked token by token, the longest are marked first, and the
search length shrinks until the shortest tile that counts.

Every tile holds a run of ``seed`` tokens that both sides share. So the items'
seeds are an index, documents stream past it once without being shuffled, and
only the few document regions under a seed go on to the tiling. The items are
gathered in blocks of bounded size, one pass over the documents for each block,
and one block is held at a time; a benchmark of ordinary size is one block.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heapify, heappop, heappush
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import ASCII_LOWER, cut, resident, small_batches, table, text_bytes, windows

#: Bytes to spaces: ASCII that is no letter or digit.
_TOKEN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in ASCII_LOWER)
#: Typographic quotes, dashes, ellipsis and spaces outside ASCII.
_OUTSIDE = re.compile("[\u00a0\u00ab\u00bb\u2000-\u206f\u3000\ufeff]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PRIME = (1 << 61) - 1


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words; punctuation separates."""
    if not text.isascii():
        text = _OUTSIDE.sub(" ", text.decode("utf-8", "replace").lower()).encode()
    return text.translate(_TOKEN).split()


def _windows(ids: Sequence[int], marked: bytearray, width: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of each window of unmarked tokens, by a rolling hash."""
    high = pow(1_000_003, width - 1, _PRIME)
    value = run = 0
    for i, token in enumerate(ids):
        if marked[i] or token < 0:
            value = run = 0
            continue
        if run == width:
            value -= (ids[i - width] + 1) * high
            run -= 1
        value = (value * 1_000_003 + token + 1) % _PRIME
        run += 1
        if run == width:
            yield value, i - width + 1


def tiles(item: Sequence[int], text: Sequence[int], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first.

    Ids below zero match nothing. Ties go to the tile that starts first in the
    item, then in the text. What is left of a match that a longer one has partly
    taken waits in the queue at its new length, so the longest free match is
    always the next.
    """
    item_marked, text_marked, found = bytearray(len(item)), bytearray(len(text)), []
    width = max(shortest, min(len(item), len(text)))
    while shortest <= min(len(item), len(text)):
        heads = defaultdict(list)
        for value, at in _windows(text, text_marked, width):
            heads[value].append(at)
        queue = []
        for value, p in _windows(item, item_marked, width) if heads else ():
            for t in heads.get(value, ()):
                if p and t and item[p - 1] == text[t - 1] >= 0 and not item_marked[p - 1] and not text_marked[t - 1]:
                    continue  # part of the match that starts one token before
                n = 0
                while (
                    p + n < len(item)
                    and t + n < len(text)
                    and item[p + n] == text[t + n]
                    and item[p + n] >= 0
                    and not item_marked[p + n]
                    and not text_marked[t + n]
                ):
                    n += 1
                if n >= width:
                    queue.append((-n, p, t))
        heapify(queue)
        while queue:
            n, p, t = heappop(queue)
            taken = bytes(map(or_, item_marked[p : p - n], text_marked[t : t - n]))
            if any(taken):
                at = 0
                for free in taken.split(b"\x01"):
                    if len(free) >= width:
                        heappush(queue, (-len(free), p + at, t + at))
                    at += len(free) + 1
                continue
            item_marked[p : p - n] = text_marked[t : t - n] = b"\x01" * -n
            found.append((p, t, -n))
        if width == shortest:
            break
        width = max(shortest, width // 2)
    return found


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], seed: int) -> None:
        self.seed, self.vocabulary = seed, {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        postings = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text)]
            if len(ids) >= seed:
                own = np.array(ids, np.int32)
                postings.append((self.hashes(own, np.arange(len(own) - seed + 1)), len(self.items)))
                self.items.append((item_id, own))
        flat = np.concatenate([h for h, _ in postings]) if postings else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(h), n) for h, n in postings]) if postings else np.zeros(0, np.int64)
        order = np.lexsort((owner, flat))
        self.seeds, self.owners = flat[order], owner[order]

    def hashes(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        value = np.zeros(len(starts), np.uint64)
        for j in range(self.seed):
            value = (value + ids[starts + j].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
            value ^= value >> np.uint64(29)
        return value

    def leaks(self, text: bytes) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, tiles, tokens covered, tokens of the item) for items with a tile in the text."""
        get = self.vocabulary.get
        words = tokens(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        n = len(ids) - self.seed + 1
        if n <= 0:
            return
        foreign = np.concatenate(([0], np.cumsum(ids < 0)))
        starts = np.flatnonzero(foreign[self.seed :] == foreign[:n])
        if not len(starts):
            return
        value = self.hashes(ids, starts)
        left = np.searchsorted(self.seeds, value, "left")
        right = np.searchsorted(self.seeds, value, "right")
        shared: dict[int, set[int]] = defaultdict(set)
        for at, a, b in zip(starts.tolist(), left.tolist(), right.tolist(), strict=True):
            for owner in self.owners[a:b].tolist():
                shared[owner].add(at)
        for owner, hits in sorted(shared.items()):
            item_id, item = self.items[owner]
            region: list[int] = []
            end = -1
            for at in sorted(hits):
                if at > end:
                    region.append(-1)
                    end = at
                region.extend(ids[end : at + self.seed].tolist())
                end = at + self.seed
            found = tiles(item.tolist(), region, self.seed)
            if found:
                yield item_id, len(found), sum(x[2] for x in found), len(item)


def index_of(shared: Broadcast, seed: int) -> Index:
    """The index of a block of items, built once in a worker process."""
    name, items = shared.value
    return resident(("items", name, seed), lambda: Index(items, seed))


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items in blocks of about ``block_bytes`` of text, and whether a block is the only one.

    Items are dealt by a hash of id and text; rows that repeat both count once.
    A block is collected and shared with the executors when it is asked for,
    so the driver holds one at a time, or one item that is longer.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("body"))
    items = items.filter("length(body) > 0").distinct()
    total = items.agg(F.sum(F.length("body"))).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks))
    context = benchmark.sparkSession.sparkContext
    small_batches(benchmark.sparkSession)
    for n in range(blocks):
        rows = items.filter(dealt == n).collect()
        own = sorted(((r[0], bytes(r[1])) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield context.broadcast((uuid.uuid4().hex, own)), blocks == 1


def overlaps(
    docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, block_bytes: int = 8 << 20
) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_tokens, coverage) with coverage >= threshold.

    ``seed`` is the shortest tile, in tokens. Items with fewer tokens, null or
    empty ones among them, are no evidence and never match; null texts match
    nothing, and an empty benchmark matches nothing. Null ids of documents and
    items stay null; documents that repeat an id are looked at one by one, items
    that repeat id and text once. Texts are read whole, however long; only what
    lies under a seed is tiled, and a text and an item that both repeat the same
    tokens over and over take time in the product of those parts. ``block_bytes``
    bounds the benchmark text that one pass over the documents holds; the
    results of the passes before the last are written to the shared folder.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    schema = "doc_id long, item_id long, n_tiles long, covered long, item_tokens long, coverage double"

    def block(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(shared, seed)
            for batch in windows(batches, "body"):
                out = [
                    (doc, item, n_tiles, covered, size, covered / size)
                    for doc, body in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)
                    for item, n_tiles, covered, size in index.leaks(body)
                    if covered >= threshold * size
                ]
                if out:
                    fields = [("doc_id", pa.int64()), *((x, pa.int64()) for x in ("item_id", "n_tiles", "covered", "item_tokens"))]
                    kinds = [*(t for _, t in fields), pa.float64()]
                    names = [*(x for x, _ in fields), "coverage"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names
                    )

        return rows.mapInArrow(run, schema)

    found = []
    for shared, only in item_blocks(benchmark, block_bytes):
        if only:
            return block(shared)
        found.append(cut(block(shared)))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document and benchmark item that it leaks, with the item's coverage."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _clean(shared: Broadcast, seed: int, threshold: float):  # type: ignore[no-untyped-def]
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        index = index_of(shared, seed)
        bodies = ((t.as_py() or "").encode("utf-8", "replace") for t in texts)
        return pa.array([all(c < threshold * n for _, _, c, n in index.leaks(b)) for b in bodies], pa.bool_())

    return clean


def remove_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item.

    The decision is taken row by row in the scan, so nothing is shuffled, rows
    with null or repeated ids are judged like any other, and columns of any
    name pass through untouched. With several blocks of items the rows that are
    left after each are written to the shared folder.
    """
    for shared, only in item_blocks(benchmark, block_bytes):

        docs = docs.filter(_clean(shared, seed, threshold)(docs["text"].cast("string")))
        if not only:
            docs = cut(docs)
            shared.unpersist()
    return docs
