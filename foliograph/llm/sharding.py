"""Resharding by minimum-cost flow.

A layout is a folder of shards, each of a number of files, which hold documents
by a hash of their text. A file has atoms, fixed ranges of the hash; equal texts
share one. From the old shards' bytes and the new shards' capacities a
minimum-cost flow is solved, where a byte that stays costs nothing and a byte
that moves costs one. The flow between two shards is carried by whole files and
by the atoms of one more file, and only files of which an atom moves are
rewritten.

The plan needs the bytes of each atom and never a document; the numbers of
shards, files and atoms are parameters and bound all that the driver sees. A
document's slot is the offset of a part of its shard and its place within that
part, so neither a shard nor a text with a third of the table is written or
sorted by one task.

A layout is read through its newest manifest, a table of the files that count
and the version that holds each. Rewritten files and their manifest are written
before old files are deleted, so a run that breaks off at any point loses and
repeats nothing.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import Scratch, remove, scratch_folder, table, text_bytes

#: The layout that the query brings to eight shards: shards, files of a shard, atoms of a file.
OLD_SHARDS, FILES, ATOMS = 6, 64, 64
#: Text that one task writes to a file at most.
TASK_BYTES = 256 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity of least total cost, by successive shortest paths.

    All numbers are integers and the capacities hold the supplies in total.
    Each round augments along a cheapest path of the residual network, found by
    Bellman-Ford relaxation over the few shards.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = 1 << 62
        near = [0 if left[i] else far for i in range(n)] + [far] * m
        came = [-1] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if near[i] < far and near[i] + cost[i][j] < near[n + j]:
                        near[n + j], came[n + j], changed = near[i] + cost[i][j], i, True
                    if flow[i][j] and near[n + j] < far and near[n + j] - cost[i][j] < near[i]:
                        near[i], came[i], changed = near[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if room[j]), key=lambda j: near[n + j])
        path, at = [], n + end
        while came[at] >= 0:
            path.append((came[at], at))
            at = came[at]
        amount = min(left[at], room[end], *(flow[b][a - n] for a, b in path if a >= n))
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def capacities(total: int, floors: list[int]) -> list[int]:
    """Equal capacities with sum ``total``, but for shards that must hold more than the equal part."""
    n, fixed = len(floors), set()
    while True:
        free = [i for i in range(n) if i not in fixed]
        rest = total - sum(floors[i] for i in fixed)
        if not free:
            return [f + (rest if i == 0 else 0) for i, f in enumerate(floors)]
        level, over = divmod(rest, len(free))
        more = {i for i in free if floors[i] > level + (1 if free.index(i) < over else 0)}
        if not more:
            return [floors[i] if i in fixed else level + (1 if free.index(i) < over else 0) for i in range(n)]
        fixed |= more


Atom = tuple[int, int, int]


def transfers(atoms: dict[Atom, int], shards: int) -> tuple[dict[Atom, int], int]:
    """({(old shard, file, atom): new shard}, bytes that the minimum-cost flow moves).

    ``atoms`` has the bytes of each. The flow between two shards is filled with
    whole files, largest first, and then with atoms of the smallest file that is
    too large. What is left by the sizes of atoms is evened out by moving single
    atoms from the fullest to the emptiest shard while that brings the two
    closer; this rounding is all that is moved beside the flow.
    """
    before = 1 + max([shards - 1, *(shard for shard, *_ in atoms)])
    old, files = [0] * before, defaultdict(dict)
    for (shard, file, atom), size in atoms.items():
        old[shard] += size
        files[shard, file][atom] = size
    largest = [max((n for (s, *_), n in atoms.items() if s == shard), default=0) for shard in range(shards)]
    capacity = capacities(sum(old), largest)
    flow = min_cost_flow(old, capacity, [[int(i != j) for j in range(shards)] for i in range(before)])
    placed = {key: key[0] for key in atoms}
    for shard in range(before):
        whole = {file: sum(own.values()) for (s, file), own in files.items() if s == shard}
        for to in sorted((j for j in range(shards) if j != shard), key=lambda j: (-flow[shard][j], j)):
            room = flow[shard][to]
            for file in sorted(whole, key=lambda f: (-whole[f], f)):
                if whole[file] <= room:
                    room -= whole.pop(file)
                    placed |= {(shard, file, atom): to for atom in files[shard, file]}
            if room and whole:
                file = min(whole, key=lambda f: (whole[f], f))
                for atom, size in sorted(files[shard, file].items(), key=lambda x: (-x[1], x[0])):
                    if size <= room:
                        room, whole[file] = room - size, whole[file] - size
                        placed[shard, file, atom] = to
                        del files[shard, file][atom]
    held, inside = [0] * shards, defaultdict(list)
    for key, to in sorted(placed.items(), key=lambda x: (x[1] >= shards, -atoms[x[0]], x[0])):
        to = to if to < shards else min(range(shards), key=lambda s: (held[s], s))  # left over in a shard that ends
        placed[key] = to
        held[to] += atoms[key]
        inside[to].append((atoms[key], key))
    stuck: set[int] = set()
    while len(stuck) < shards - 1:
        full = max((s for s in range(shards) if s not in stuck), key=lambda s: (held[s], s))
        empty = min(range(shards), key=lambda s: (held[s], s))
        gap = held[full] - held[empty]
        best = min((x for x in inside[full] if 0 < x[0] < gap), key=lambda x: (abs(2 * x[0] - gap), x[1]), default=None)
        if best is None:
            stuck.add(full)
            continue
        inside[full].remove(best)
        inside[empty].append(best)
        placed[best[1]] = empty
        held[full], held[empty] = held[full] - best[0], held[empty] + best[0]
    return placed, sum(flow[i][j] for i in range(before) for j in range(shards) if i != j)


# -- layouts ----------------------------------------------------------------------------------------------------
def _places(text: Column, shards: int, files: int) -> list[Column]:
    """Shard and file of a text in a new layout."""
    code = F.xxhash64(text)
    return [F.pmod(code, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(code), F.lit(files)).cast("int").alias("file")]


def _atom(text: Column, atoms: int) -> Column:
    return F.pmod(F.xxhash64(F.xxhash64(F.xxhash64(text))), F.lit(atoms)).cast("int").alias("atom")


def _write(rows: DataFrame, path: str, version: int) -> None:
    """Rows (row, shard, file) as folders of a version; a file with many bytes is written by as many tasks as it asks for."""
    held = rows.groupBy("shard", "file").agg(F.sum(F.length(text_bytes("row.text")) + 1).alias("bytes")).collect()
    part = min(TASK_BYTES, max(1, 2 * sum(r["bytes"] for r in held) // max(len(held), 1)))
    parts = rows.sparkSession.createDataFrame([(r["shard"], r["file"], -(-r["bytes"] // part)) for r in held], "shard int, file int, parts long")
    dealt = rows.join(F.broadcast(parts), ["shard", "file"])  # a row for each file
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))).repartition("shard", "file", "part")
    dealt.select("row", "shard", "file").write.partitionBy("shard", "file").parquet(f"{path}/version={version}")


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(number, rows (shard, file, version)) of the newest whole manifest."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(place)]
    whole = [int(p.getName()) for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(whole), spark.read.schema("shard int, file int, version int").parquet(f"{path}/manifests/{max(whole)}")


def write_layout(docs: DataFrame, path: str, shards: int = OLD_SHARDS, files: int = FILES) -> None:
    """Lay documents out under ``path`` by the hash of their text; all their columns are kept, whatever their names."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), *_places(text_bytes(), shards, files))
    rows.select("row").limit(0).write.parquet(f"{path}/schema")  # folders of an empty table would hold none
    _write(rows, path, 0)
    own = [(s, f, 0) for s in range(shards) for f in range(files)]
    spark.createDataFrame(own, "shard int, file int, version int").coalesce(1).write.parquet(f"{path}/manifests/0")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(row, shard, file) of a layout's documents."""
    _, files = _manifest(spark, path)
    versions = sorted(r[0] for r in files.select("version").distinct().collect())
    schema = f"row {spark.read.parquet(f'{path}/schema').schema['row'].dataType.simpleString()}, shard int, file int"
    stored = [spark.read.schema(schema).parquet(f"{path}/version={v}").join(F.broadcast(files.filter(files["version"] == v)), ["shard", "file"]) for v in versions]
    return reduce(DataFrame.unionByName, stored).select("row", "shard", "file")


def reshard(spark: SparkSession, path: str, shards: int = 8, atoms: int = ATOMS) -> tuple[int, int, int]:
    """Bring a layout to ``shards`` shards of near equal bytes; rewrites the files of which an atom moves.

    Returns (bytes moved, bytes of the minimum-cost flow, files rewritten). A
    part of a file that goes to another shard is a file there, numbered apart
    from that shard's own.
    """
    number, manifest = _manifest(spark, path)
    stored = read_layout(spark, path).withColumn("atom", _atom(text_bytes("row.text"), atoms))
    sizes = stored.groupBy("shard", "file", "atom").agg(F.sum(F.length(text_bytes("row.text")) + 1).alias("bytes"))
    bytes_of = {(r[0], r[1], r[2]): r[3] for r in sizes.collect()}
    placed, cost = transfers(bytes_of, shards)
    changed = {key[:2] for key, to in placed.items() if key[0] != to}
    if not changed:
        return 0, cost, 0
    known = {(r["shard"], r["file"]): r["version"] for r in manifest.collect()}
    names = {pair: n for n, pair in enumerate(sorted(changed), 1 + max(f for _, f in known))}
    moves = [(s, f, a, to, f if to == s else names[s, f]) for (s, f, a), to in placed.items() if (s, f) in changed]
    plan = F.broadcast(spark.createDataFrame(moves, "shard int, file int, atom int, to_shard int, to_file int"))  # a row for each atom at most
    going = stored.join(plan, ["shard", "file", "atom"]).select("row", F.col("to_shard").alias("shard"), F.col("to_file").alias("file"))
    _write(going, path, number + 1)
    kept = [(s, f, v) for (s, f), v in known.items() if (s, f) not in changed]
    kept += [(s, f, number + 1) for s, f in sorted({(to, f) for *_, to, f in moves})]
    spark.createDataFrame(kept, "shard int, file int, version int").coalesce(1).write.parquet(f"{path}/manifests/{number + 1}")
    remove(spark, *(f"{path}/version={known[pair]}/shard={pair[0]}/file={pair[1]}" for pair in changed))
    return sum(bytes_of[key] for key, to in placed.items() if key[0] != to), cost, len(changed)


# -- documents --------------------------------------------------------------------------------------------------
def assign(docs: DataFrame, shards: int = 8, old_shards: int = OLD_SHARDS, files: int = FILES, atoms: int = ATOMS, parts: int = 512) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    The documents are laid out in ``old_shards`` shards, and that layout is
    brought to ``shards`` shards by moving the fewest bytes. Size is the text's
    UTF-8 bytes plus one; null counts as empty. Shards have near equal bytes,
    equal texts lie in one shard, and a text whose copies outweigh an equal part
    gets a shard that is as full as they make it, with the others equal. Slots
    count from 0 without gaps within each shard. Texts may have any length;
    repeated rows, null ids among them, take a slot each; an empty table gives
    no row; other columns are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    path = scratch_folder(spark, "layout")
    write_layout(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path, old_shards, files)
    reshard(spark, path, shards, atoms)
    body = text_bytes("row.text")
    row = F.monotonically_increasing_id()
    found = read_layout(spark, path).select(row.alias("row"), "row.doc_id", (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "shard")
    rows = scratch.put(found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")))
    remove(spark, path)
    following, starts = [0] * shards, []
    for shard, part, n in sorted(map(tuple, rows.groupBy("shard", "part").count().collect())):
        starts.append((shard, part, following[shard]))
        following[shard] += n
    first = F.broadcast(spark.createDataFrame(starts, "shard int, part int, first long"))  # shards * parts rows
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return rows.join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + within).cast("long").alias("slot"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: shard and slot of every document, under the law that shards have near equal bytes."""
    return digest(assign(table(spark, sf_dir, "documents")))
