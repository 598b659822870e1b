"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in
at most ``d`` bits differ in at most ``d`` bytes, so they share at least
``8 - d`` positional bytes: that is the guaranteed minimum of the count filter.
Posting lists of single positional bytes would hold one 256th of the corpus
each; here a posting is keyed by the guaranteed minimum of bytes at once (56
keys of five bytes for ``d = 3``), so that two fingerprints that meet in a list
have reached the minimum, none that reaches it is missed, and the tallies of
pairs below it are never made. Within a list the tally over all eight
positions is taken, and the pairs are verified bit by bit.

A list is bounded however skewed the corpus is: equal fingerprints are one
entry, and five fixed bytes leave 24 free bits. A list longer than ``LIST`` is
keyed further in the same way: the half bytes that its key leaves free are
positions too, and of twice ``d`` of them at least ``d`` agree, so its entries
meet again in lists keyed by each choice of that many half bytes, which have
2 ** 12 entries at most for ``d = 3``. Postings are dealt by key over as many
partitions as they need and sorted there, so lists with one entry, which are
nearly all, cost no more than their sort. Within a list links are followed
breadth first from one entry to those not reached yet, so a dense list of near
copies costs about one pass and yields a spanning forest and never all its
pairs. The forests of all lists have the same components as the full link graph.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import ASCII_LOWER, Scratch, cut, resident, small_batches, table, text_bytes, windows
from foliograph.llm.components import components

SEED, BITS, BYTES = 42, 64, 8
#: Lists longer than this are keyed further, and a partition has about so many postings; no result depends on either.
LIST, POSTINGS = 4096, 1 << 22


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of ``width``-word shingles (repeats counted), as an unsigned integer.

    Words are runs without ASCII white space after A-Z is lower-cased. With
    fewer words than ``width`` the whole sequence is the one shingle; without
    any word the fingerprint is zero.
    """
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    return int(_majority(hashes)[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes, as one integer."""
    ones, step = np.zeros(BITS, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit integer; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows(batches, "body"):
            values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def byte_masks(distance: int) -> list[int]:
    """The bits of each choice of ``8 - distance`` positions."""
    return [sum(0xFF << (8 * p) for p in kept) for kept in combinations(range(BYTES), BYTES - distance)]


def half_byte_masks(mask: int, distance: int) -> list[int]:
    """The bits of a choice of positions, and of each choice of ``distance`` of the half bytes that it leaves."""
    free = [0xF << (4 * p) for p in range(2 * BYTES) if not mask >> (4 * p) & 0xF]
    return [mask | sum(kept) for kept in combinations(free, distance)]


def _scan(entries: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of one list's links, breadth first."""
    rest, queue = entries, []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        here = queue.pop()
        differ = rest ^ here
        tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = (tally >= BYTES - distance) & (np.bitwise_count(differ) <= distance)
        for other in rest[near]:
            yield here, other
        queue.extend(rest[near])
        rest = rest[~near]


def _forest(entries: np.ndarray, mask: int, distance: int, further: bool = True) -> Iterator[np.ndarray]:
    """Links of distinct entries in the lists of one choice of positions, as rows of two."""
    keys = entries & np.uint64(mask)
    order = np.argsort(keys, kind="stable")
    own, keys = entries[order], keys[order]
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    sizes = np.diff(ends, prepend=0)
    two = ends[sizes == 2]  # most lists that have links at all
    pairs = np.stack([own[two - 2], own[two - 1]], axis=1)
    yield pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= distance]
    for end, size in zip(ends[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        held = own[end - size : end]
        if size > LIST and further:
            for wider in half_byte_masks(mask, distance):
                yield from _forest(held, wider, distance, further=False)
        else:
            yield np.array(list(_scan(held, distance)), np.uint64).reshape(-1, 2)


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` whose components are those of all links."""
    masks = byte_masks(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        prints, choices = (np.concatenate(x) for x in zip(*held, strict=True))
        for n, mask in enumerate(masks):
            found = np.concatenate(list(_forest(np.unique(prints[choices == n]), mask, distance)))
            if len(found):
                pairs = np.sort(found, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # fingerprints are few bytes and lie in few partitions; their postings are many
    spread = prints.select("fp").repartition(parts, "fp")
    postings = spread.select("fp", F.explode(F.array(*[F.lit(n).cast("byte") for n in range(len(masks))])).alias("n"))
    # the key follows from fingerprint and choice, so it need not be sent along
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("n") + 1))
    dealt = postings.repartition(max(parts, -(-prints.count() * len(masks) // POSTINGS)), F.col("n"), key)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, distance: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id keep a row; they count as copies but never name a component
    unless it has no other row, when component_id is null. Repeated rows give
    repeated rows, and an empty table gives none. Texts of any length are hashed
    whole. Only ids and fingerprints leave the scan: texts are read once and
    never shuffled.
    """
    prints = cut(fingerprints(docs, width, id_col, text_col))
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    members = components(links(least.select("fp"), distance), "a", "b")
    grouped = cut(members.join(least, members.node == least.fp).select("fp", "root", "least"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = grouped.join(named, "root").select("fp", "component_id")
    # cut, so that the last join has an exchange of its own on either side and a hot fingerprint can be split
    classes = cut(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: doc_id, fingerprint (16 hex digits), component_id for every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- similarity on word shingles --------------------------------------------------------------------------------
# The byte-position index finds texts whose fingerprints differ in three bits at most, the closest of copies; a
# similarity of 0.8 guarantees no such distance. What that guarantee does not reach is found by the same count
# filtering on the shingles themselves, an exact set-similarity join. Under any order of all shingles, two sets of
# similarity t share at least m of their first n - ceil(t n) + m. So each set is indexed by that many, with m from
# 1 + n / SLACK, and the guaranteed minimum of a pair follows from its two sizes. A pair that shares m of its indexed
# shingles shares one that is not among the m - 1 most held ones of either; those need not be looked at. As nearly all
# shingles have one holder, long texts that share a passage and no more drop out there. The first order puts shingles
# that many texts hold last. Both orders decide how many candidates there are and never which pairs are found. What is
# left is bounded by sizes, places and a parity bitmap, bounds that no similar pair breaks, and decided on whole sets.

#: Bits of a shingle's heat bucket; bytes of the parity bitmap; shingles for each one that a pair must share more.
HEAT_BITS, PARITY_BYTES, SLACK = 20, 256, 32
#: Entries of a part of a posting list; all pairs of parts are compared, each pair of parts in a task of its own.
CHUNK = 4096
#: Slots of the bitmap of texts that a pass has to look at; the others go past unread or stay where they are.
SLOTS = 1 << 23


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the distinct ``width``-word shingles of a text, in order; a shorter text is one shingle."""
    words = text.translate(ASCII_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, 7)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], 7) for a, b in spans), np.uint64, len(words) - width + 1))


def heat(docs: DataFrame, width: int, text_col: str = "text") -> np.ndarray:
    """For each bucket of shingles how many occurrences its crowded tasks count, 0 for buckets crowded nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("shingles", bool)
        counts = np.zeros(1 << HEAT_BITS, np.int64)
        for batch in windows(batches, "body"):
            own = np.concatenate([shingles(t, width) for t in batch.column(0).to_pylist()])
            counts += np.bincount((own >> np.uint64(64 - HEAT_BITS)).astype(np.int64), minlength=len(counts))
        crowded = np.flatnonzero(counts > max(8, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(crowded, pa.int64()), pa.array(counts[crowded], pa.int64())], ["bucket", "n"])

    rows = docs.select(text_bytes(text_col).alias("body")).mapInArrow(run, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2^20 rows, and few of them crowded
    out = np.zeros(1 << HEAT_BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def needed(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares with every set of this similarity."""
    return math.ceil(similarity * n - 1e-9)


def minimum(n: int) -> int:
    """Indexed shingles that a set of ``n`` shares with every similar set that is not smaller."""
    return 1 + n // SLACK


def indexed(n: int, similarity: float) -> int:
    """How many of its shingles a set of ``n`` is indexed by."""
    return n - needed(n, similarity) + minimum(n) if n else 0


def shared_minimum(n: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Indexed shingles that entry ``i`` shares with each of ``others`` if they are similar."""
    common = np.ceil((n[others] + n[i]) * (similarity / (1 + similarity)) - 1e-6).astype(np.int64)
    beyond = np.ceil(similarity * n - 1e-9).astype(np.int64) - 1 - n // SLACK  # shingles that are not indexed
    return common - np.maximum(beyond[others], beyond[i])


def _digest(shingles: np.ndarray) -> bytes:
    """A name for a set of shingles, which are in order."""
    return xxhash.xxh3_128_digest(shingles.tobytes(), SEED)


def shingled(docs: DataFrame, order: np.ndarray, similarity: float, width: int, text_col: str = "text") -> DataFrame:
    """(id, text_key, digest, fp, n, bits, keys) of each text's distinct shingles; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in windows(batches, "body"):
            out = []
            for text in batch.column(2).to_pylist():
                own = shingles(text, width)
                first = np.lexsort((own, order[own >> np.uint64(64 - HEAT_BITS)]))[: indexed(len(own), similarity)]
                odd = np.bincount((own % np.uint64(8 * PARITY_BYTES)).astype(np.int64), minlength=8 * PARITY_BYTES) & 1
                out.append((_digest(own), _majority(own).view(np.int64)[0], len(own), np.packbits(odd.astype(np.uint8)).view(np.int64), own[first].view(np.int64)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text_key", "digest", "fp", "n", "bits", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _text_key(F.col(text_col)).alias("text_key"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "id long, text_key long, digest binary, fp long, n long, bits array<long>, keys array<long>")


def _text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _slot(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(SLOTS))


def bitmap(rows: DataFrame) -> bytes:
    """A bit for each slot that a row (id, text_key) falls into."""
    marks = rows.select((_slot("id", "text_key") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
    mask = np.zeros((SLOTS // 32768, 4096), np.uint8)
    for bucket, bits in marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():  # at most 256 rows of 4 KB
        mask[bucket - 1] = np.frombuffer(bytes(bits), np.uint8)
    return mask.tobytes()


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """(node, own) the whole sets of the texts that ``wanted`` (node, id, text_key) names; other texts are not hashed."""
    packed = bitmap(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_wanted = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        for batch in windows(batches, "body"):
            kept = batch.filter(pa.array(is_wanted[batch.column(2).to_numpy()]))
            if len(kept):
                sets = [shingles(t, width).view(np.int64) for t in kept.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(sets, pa.list_(pa.int64()))], ["id", "text_key", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _text_key(F.col(text_col)).alias("text_key"), text_bytes(text_col).alias("body"))
    sets = rows.select("id", "text_key", _slot("id", "text_key").alias("at"), "body").mapInArrow(run, "id long, text_key long, own array<long>")
    return sets.join(wanted, ["id", "text_key"]).select("node", "own")


def _near(n: np.ndarray, left: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``others`` may be similar to entry ``i`` by size and by place, if this is the first shingle they share.

    ``left`` counts the indexed shingles from this one on, the rarest first.
    """
    fits = np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - 1e-6
    return fits & (np.minimum(left[others], left[i]) >= shared_minimum(n, i, others, similarity))


def stars(nodes: np.ndarray, n: np.ndarray, left: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of one list that are worth a first look: each entry with one smaller head that it may be similar to."""
    rest = np.argsort(nodes, kind="stable")
    while len(rest) > 1:
        head, rest = rest[0], rest[1:]
        near = _near(n, left, head, rest, similarity)
        yield from ((int(nodes[head]), int(b)) for b in nodes[rest[near]])
        rest = rest[~near]


def crossing(nodes: np.ndarray, n: np.ndarray, left: np.ndarray, part: np.ndarray, root: np.ndarray, bits: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """All pairs of a list, or between its two parts, that are in different groups and that no bound rules out."""
    two, everyone = len(np.unique(part)) > 1, np.arange(len(nodes))
    for i in everyone[part == part.min()] if two else everyone:
        others = everyone[part != part[i]] if two else everyone[i + 1 :]
        others = others[root[others] != root[i]]
        others = others[_near(n, left, i, others, similarity)]
        differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        # the symmetric difference has an element for each position of odd parity, at least
        for j in others[differ <= (n[others] + n[i]) * ((1 - similarity) / (1 + similarity)) + 1e-6]:
            yield tuple(sorted((int(nodes[i]), int(nodes[j]))))


def _pairs(lists: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(a, b), a < b: what ``stars`` or, with ``every``, ``crossing`` finds in the lists of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, ends = batch.column(0).flatten(), batch.column(0).value_lengths().to_numpy().cumsum()
            own = dict(zip([f.name for f in entries.type], entries.flatten(), strict=True))
            columns = [own[c].to_numpy() for c in (("node", "n", "left", "part", "root") if every else ("node", "n", "left"))]
            columns += [own["bits"].flatten().to_numpy().view(np.uint64).reshape(-1, PARITY_BYTES // 8)] if every else []
            find = crossing if every else stars
            found = {pair for first, last in zip([0, *ends], ends) for pair in find(*(c[first:last] for c in columns), similarity)}  # noqa: B905
            if found:
                pairs = np.array(sorted(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return lists.select("entries").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def verified(scratch: Scratch, docs: DataFrame, distinct: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    bits = distinct.select("node", "n", "bits")
    sides = [bits.select(*[F.col(c).alias(f"{c}_{s}") for c in bits.columns]) for s in "ab"]
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    bound = (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    near = scratch.put(pairs.join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b")).filter(apart <= bound).select("a", "b"))
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.put(distinct.join(nodes, "node", "left_semi").select("node", "id", "text_key"))
    sets = scratch.put(shingle_sets(docs, wanted, width))
    # a head's set goes once to all that it is paired with
    heads = sets.join(near.select(F.col("a").alias("node")).distinct(), "node", "left_semi").toDF("a", "own_a")
    whole = near.join(sets.toDF("b", "own_b"), "b").join(heads, "a")
    common = F.size(F.array_intersect("own_a", "own_b"))
    linked = common >= F.lit(similarity) * (F.size("own_a") + F.size("own_b") - common)
    return scratch.put(whole.filter(linked).select("a", "b"))


def entries_of(scratch: Scratch, distinct: DataFrame, similarity: float) -> DataFrame:
    """(node, n, key, left, held, part): the postings that a similar pair must meet in, by lists of more than one."""
    postings = distinct.select("node", "n", F.size("keys").alias("size"), F.explode("keys").alias("key"))
    counts = scratch.put(postings.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    shared = scratch.put(postings.join(counts, "key"))
    of_node = Window.partitionBy("node")
    rank = F.row_number().over(of_node.orderBy("held", "key"))
    # the shingles that no other text is indexed by come first
    left = F.count(F.lit(1)).over(of_node) - rank + 1
    least = 1 + F.floor(F.ceil(F.lit(similarity) * F.col("n") - 1e-9) / SLACK)
    kept = scratch.put(shared.select("node", "n", "key", left.alias("left")).filter(F.col("left") >= least))
    lists = kept.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("held") / CHUNK))
    return scratch.put(kept.join(lists, "key").select("node", "n", "key", "left", "held", part.alias("part")))


def near_prints(scratch: Scratch, distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b), a < b: texts whose fingerprints are equal or linked by the byte-position index, by one text of each fingerprint."""
    first = scratch.put(distinct.groupBy("fp").agg(F.min("node").alias("first")))
    same = distinct.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    sides = [first.select(F.col("fp").alias(s), F.col("first").alias(f"first_{s}")) for s in "ab"]
    linked = links(first.select("fp"), distance).join(sides[0], "a").join(sides[1], "b")
    return same.unionByName(linked.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def similar_links(scratch: Scratch, docs: DataFrame, distinct: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b) links whose components are those of all similar pairs of the rows (node, id, text_key, fp, n, bits, keys)."""
    dealt = entries_of(scratch, distinct, similarity)
    # first the true families, in about as many pairs as they have entries: by the fingerprints, and by stars in the lists
    lists = dealt.groupBy("key", "part").agg(F.collect_list(F.struct("node", "n", "left")).alias("entries"))
    first = scratch.put(_pairs(lists, similarity, every=False).unionByName(near_prints(scratch, distinct)).distinct())
    links = verified(scratch, docs, distinct, first, similarity, width)
    # then every pair of a list that is not in one group yet; part i meets part j, i <= j, in a task of their own
    groups = scratch.put(components(links, "a", "b").withColumnRenamed("node", "member"))
    rooted = dealt.filter("held > 2").join(groups, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    still = scratch.put(rooted.join(mixed, "key").select("node", "n", "left", "key", "held", "part", "root"))
    parts = F.ceil(F.col("held") / CHUNK)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    meeting = still.join(distinct.select("node", "bits"), "node").withColumn("meets", F.explode(meets))
    lists = meeting.groupBy("key", "meets").agg(F.collect_list(F.struct("node", "n", "left", "part", "root", "bits")).alias("entries"))
    more = scratch.put(_pairs(lists, similarity, every=True).join(links, ["a", "b"], "left_anti"))
    return scratch.put(links.unionByName(verified(scratch, docs, distinct, more, similarity, width)).distinct())


def chosen_rows(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(id, text_key): the row with the smallest id of each group of texts linked by shingle similarity.

    ``text_key`` is a 64-bit hash of the text, which tells rows that repeat an
    id apart.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    named = docs.filter(F.col("doc_id").isNotNull())
    rows = shingled(named, heat(named, width), similarity, width)
    first = F.min(F.struct("id", "text_key")).alias("first")
    sets = rows.groupBy("digest").agg(first, *(F.first(c).alias(c) for c in ("fp", "n", "bits", "keys")))
    distinct = scratch.put(sets.select(F.monotonically_increasing_id().alias("node"), "first.id", "first.text_key", "fp", "n", "bits", "keys"))
    members = components(similar_links(scratch, named, distinct, similarity, width), "a", "b").withColumnRenamed("node", "member")
    own = distinct.select("node", "id", "text_key").join(members, F.col("node") == F.col("member"), "left")
    chosen = own.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "text_key")).alias("first"))
    kept = Scratch(docs.sparkSession).put(chosen.select("first.*"))
    scratch.remove()
    return kept


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without all but one row of each near-duplicate group.

    Texts link when their distinct ``width``-word shingles, as 64-bit hashes,
    have a Jaccard similarity of at least ``similarity``; groups are what links
    connect. The row with the smallest doc_id stays; where that id repeats with
    several texts of the group, one of them does, and of rows that repeat id and
    text one does. Different texts with one id are judged each for itself. Null,
    empty and blank texts are one group. Rows without an id have nothing to be
    told apart by and all stay. Texts of any length are compared whole; an empty
    table gives no row. Other columns are untouched, whatever their names.
    """
    kept = chosen_rows(docs, similarity, width)
    row_id, key = docs["doc_id"].cast("long"), _text_key(docs["text"])
    held = docs.select(row_id.alias("id"), key.alias("text_key")).filter("id IS NOT NULL").groupBy("id", "text_key").count()
    judged = held.join(kept.withColumn("stays", F.lit(True)), ["id", "text_key"], "left")
    # most rows stay and stand alone; only texts in a slot with another kind of row are moved and looked up
    unsure = Scratch(docs.sparkSession).put(judged.filter("stays IS NULL OR count > 1"))
    packed = bitmap(unsure)

    @F.arrow_udf("boolean")
    def sure(slots: pa.Array, ids: pa.Array) -> pa.Array:
        marked = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        return pa.array(~marked[slots.to_numpy()] | ids.is_null().to_numpy(zero_copy_only=False))

    is_sure = sure(F.pmod(F.xxhash64(row_id, key), F.lit(SLOTS)), row_id)
    rest = docs.filter(~is_sure)
    here = lambda of: rest.join(of, (row_id == of["id"]) & (key == of["text_key"]), "left_semi")
    again = unsure.filter("stays AND count > 1").select("id", "text_key")
    once = docs.filter(is_sure).union(here(kept.join(again, ["id", "text_key"], "left_anti")))
    return once if again.isEmpty() else once.union(here(again).dropDuplicates(["doc_id", "text"]))
