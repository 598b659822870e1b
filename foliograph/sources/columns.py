"""Rows between Arrow batches and Python, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of frames, and bytes, that a worker gathers before it hands them on; bytes of an Arrow batch that it is given.
ROWS, BYTES = 20_000, 8 << 20


def bound(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that workers hold few files at a time; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = (spark.conf.get(name, None) or "").rstrip("b")
    if not own.isdigit() or not 0 < int(own) <= BYTES:
        spark.conf.set(name, str(BYTES))


def plain(a: pa.Array) -> list[Any]:
    """Python values of an array, by columns and not value by value."""
    if pa.types.is_struct(a.type):
        names = [a.type.field(i).name for i in range(a.type.num_fields)]
        out = [dict(zip(names, r, strict=True)) for r in zip(*map(plain, a.flatten()), strict=True)]
    elif pa.types.is_list(a.type):
        offsets = a.offsets.to_numpy(zero_copy_only=False).tolist()
        values = plain(a.values.slice(offsets[0], offsets[-1] - offsets[0])) if a.type.num_fields else []
        first = offsets[0]
        out = [values[i - first : j - first] for i, j in zip(offsets, offsets[1:], strict=False)]
    elif not a.null_count and (pa.types.is_integer(a.type) or pa.types.is_boolean(a.type)):
        return a.to_numpy(zero_copy_only=False).tolist()
    else:
        return a.to_pylist()
    return [x if v else None for x, v in zip(out, a.is_valid().to_pylist(), strict=True)] if a.null_count else out


def rows(batches: Iterable[pa.RecordBatch], name: str, limit: int = ROWS) -> Iterator[tuple[str, dict[str, Any]]]:
    """(doc_id, row) of batches, turned into Python values in slices whose array ``name`` has about ``limit`` items at most."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(name)).value_lengths().to_pylist()
        start, held = 0, 0
        for i in range(len(sizes) + 1):
            if i == len(sizes) or i > start and (held + (sizes[i] or 0) > limit or i - start >= 1000):
                part = batch.slice(start, i - start)
                cols = {n: plain(part.column(k)) for k, n in enumerate(part.schema.names)}
                for r in zip(*cols.values(), strict=True):
                    row = dict(zip(cols, r, strict=True))
                    yield row["doc_id"], row
                start, held = i, 0
            held += (sizes[i] or 0) if i < len(sizes) else 0


def files(made: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """(doc_id, content) rows as batches of bounded size."""
    docs: list[str] = []
    contents: list[bytes] = []
    held = 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(contents, pa.binary())], ["doc_id", "content"])
    for doc, content in made:
        docs.append(doc)
        contents.append(content)
        held += len(content)
        if held > BYTES or len(docs) >= ROWS:
            yield flush()
            docs, contents, held = [], [], 0
    if docs:
        yield flush()


def _lists(own: list[list[dict[str, Any]]], kind: pa.StructType) -> pa.Array:
    offsets, flat = [0], []
    for x in own:
        flat += x
        offsets.append(len(flat))
    values = [pa.array([r.get(f.name) for r in flat], f.type) for f in kind]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, fields=list(kind)))


def nested(batches: Iterable[pa.RecordBatch], read: Callable[[str, bytes | None], tuple[dict[str, Any], int]], kinds: dict[str, pa.StructType]) -> Iterator[pa.RecordBatch]:
    """A row for each file of (doc_id, content): what ``read`` finds in it as lists of rows of these kinds.

    ``read`` gives the lists by name and the bytes of what is long in them.
    """
    out: list[dict[str, Any]] = []
    held = size = 0

    def flush() -> pa.RecordBatch:
        arrays = [pa.array([r["doc_id"] for r in out], pa.string()), *(_lists([r[n] for r in out], kind) for n, kind in kinds.items())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *kinds])

    for batch in batches:
        for doc, content in zip(batch.column(0), batch.column(1), strict=True):
            row, more = read(doc.as_py(), content.as_py())
            out.append(row)
            held += 1 + sum(len(row[n]) for n in kinds)
            size += more
            if held >= ROWS or size >= BYTES:
                yield flush()
                out, held, size = [], 0, 0
    if out:
        yield flush()
