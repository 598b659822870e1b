"""Legacy binary documents: compound files of record streams.

The container is read by a small reader of its own; a stream is a sequence of
records whose 32-bit heads give tag, level and size. Records come out as rows,
so that censuses and audits are aggregations, and body text as paragraphs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from foliograph.schema import LANGUAGES, LIMITS, TAG_NAMES
from foliograph.sources import columns, layouts

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE = 0xFFFFFFFA  # sector numbers from here on are marks
#: Control characters of body text that stand alone; others fill eight code units.
_ALONE = {0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31}
#: What stands for a code in plain text; other controls leave an object mark, these none.
_SHOWN = {9: "\t", 10: "\n", 24: "-", 30: " ", 31: " "}
_SILENT = {0, 2, 3, 4, 13}


class Entry(NamedTuple):
    path: str
    kind: str
    data: bytes


class Record(NamedTuple):
    tag: int
    level: int
    data: bytes


def entries(data: bytes) -> list[Entry]:
    """Storages and streams of a compound file, by path."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    fat_count, first_dir, _, cutoff, first_small, _, first_more, more_count = struct.unpack_from("<I I 4s I I I I I", data, 44)
    size = 1 << shift

    def sector(n: int) -> bytes:
        return data[(n + 1) * size : (n + 2) * size]

    def numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    heads, more = numbers(data[76:512]), first_more
    for _ in range(more_count):
        block = numbers(sector(more))
        heads, more = heads + block[:-1], block[-1]
    table = [n for head in heads[:fat_count] if head < _FREE for n in numbers(sector(head))]

    def chain(first: int, links: list[int]) -> Iterator[int]:
        seen = set()
        while first < _FREE and first < len(links) and first not in seen:
            seen.add(first)
            yield first
            first = links[first]

    directory = b"".join(map(sector, chain(first_dir, table)))
    small_links = [n for s in chain(first_small, table) for n in numbers(sector(s))]
    nodes = []
    for at in range(0, len(directory), 128):
        raw = directory[at : at + 128]
        if len(raw) < 128:
            break
        length, kind = struct.unpack_from("<HB", raw, 64)
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, total = struct.unpack_from("<IQ", raw, 116)
        nodes.append((raw[: max(length - 2, 0)].decode("utf-16-le", "replace"), kind, left, right, child, start, total))
    if not nodes:
        return []
    small = b"".join(map(sector, chain(nodes[0][5], table)))
    found: list[Entry] = []
    waiting, seen = [(nodes[0][4], "")], set()
    while waiting:
        n, prefix = waiting.pop()
        if n >= len(nodes) or n in seen:
            continue
        seen.add(n)
        name, kind, left, right, child, start, total = nodes[n]
        waiting += [(left, prefix), (right, prefix)]
        path = f"{prefix}/{name}" if prefix else name
        if kind == 1:
            found.append(Entry(path, "Storage", b""))
            waiting.append((child, path))
        elif kind == 2:
            if total < cutoff:
                width = 1 << small_shift
                body = b"".join(small[i * width : (i + 1) * width] for i in chain(start, small_links))
            else:
                body = b"".join(map(sector, chain(start, table)))
            found.append(Entry(path, "Stream", body[:total]))
    return sorted(found)


def build(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, at the top or in one storage each; all lie in large sectors."""
    size, end, none, table_mark = 512, 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD
    sectors: list[bytes] = []
    links: list[int] = []

    def put(body: bytes) -> int:
        first, count = len(sectors), -(-len(body) // size)
        if not count:
            return end
        sectors.extend(body[i * size : (i + 1) * size].ljust(size, b"\0") for i in range(count))
        links.extend([*range(first + 1, first + count), end])
        return first

    def node(name: str, kind: int, right: int = none, child: int = none, start: int = 0, total: int = 0) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", none, right, child) + bytes(36) + struct.pack("<IQ", start, total)

    inside: dict[str, list[str]] = {}
    for path in sorted(streams):
        storage, _, _ = path.rpartition("/")
        inside.setdefault(storage, []).append(path)
    tops = [("", path) for path in inside.get("", [])] + [(storage, "") for storage in inside if storage]
    nodes, later = [node("Root Entry", 5, child=1 if tops else none)], 1 + len(tops)
    below: list[bytes] = []
    for n, (storage, path) in enumerate(tops):
        right = n + 2 if n + 1 < len(tops) else none
        if path:
            nodes.append(node(path, 2, right, start=put(streams[path]), total=len(streams[path])))
            continue
        own = inside[storage]
        nodes.append(node(storage, 1, right, child=later))
        for i, p in enumerate(own):
            below.append(node(p[len(storage) + 1 :], 2, later + i + 1 if i + 1 < len(own) else none, start=put(streams[p]), total=len(streams[p])))
        later += len(own)
    directory = put(b"".join(nodes + below))
    count = 1
    while count * 128 < len(links) + count:
        count += 1
    tables = list(range(len(sectors), len(sectors) + count))
    links += [table_mark] * count
    table = struct.pack(f"<{len(links)}I", *links).ljust(count * size, b"\xff")
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, count, directory, 0, 0, end, 0, end, 0)
    return head.ljust(76, b"\0") + struct.pack("<109I", *tables, *[none] * (109 - count)) + b"".join(sectors) + table


def inflate(data: bytes) -> bytes:
    """Raw deflate, or with a zlib head; within the limits of size and of whole-number ratio."""
    last: Exception | None = None
    for bits in (-15, 15):
        try:
            reader = zlib.decompressobj(bits)
            out = reader.decompress(data, LIMITS["stream"] + 1)
        except zlib.error as e:
            last = e
            continue
        if len(out) > LIMITS["stream"] or len(out) // max(len(data), 1) > LIMITS["ratio"]:
            raise ValueError("stream expands too far")
        return out
    raise ValueError(str(last))


def records(data: bytes) -> Iterator[Record]:
    """Records of a stream; a record that ends early is an error."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("record head is cut")
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                raise ValueError("record size is cut")
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if at + size > len(data):
            raise ValueError("record is cut")
        yield Record(head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size])
        at += size


def make_record(tag: int, level: int, data: bytes) -> bytes:
    long = len(data) >= 0xFFF
    return struct.pack("<I", tag | level << 10 | (0xFFF if long else len(data)) << 20) + (struct.pack("<I", len(data)) if long else b"") + data


def paragraph_text(data: bytes) -> str:
    """Text of a paragraph record; a wide control takes eight code units and leaves an object mark."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    out: list[str] = []
    run: list[int] = []
    flush = lambda: out.append(struct.pack(f"<{len(run)}H", *run).decode("utf-16-le", "replace")) if run else None
    at = 0
    while at < len(units):
        unit = units[at]
        if unit >= 32:
            run.append(unit)
            at += 1
            continue
        flush()
        run = []
        out.append(_SHOWN.get(unit, "" if unit in _SILENT else "￼"))
        at += 1 if unit in _ALONE else 8
    flush()
    return "".join(out)


#: Controls by their four letters, and where the paragraphs of each stand.
_CONTROLS = {
    "tbl ": ("Table", "table/tc/subList"), "gso ": ("Shape", "rect/drawText/subList"), "head": ("Header", "header/subList"), "foot": ("Footer", "footer/subList"),
    "fn  ": ("Footnote", "footnote/subList"), "en  ": ("Endnote", "endnote/subList"), "eqed": ("Equation", None), "secd": ("Section", None), "cold": ("Columns", None),
    "pgnp": ("PageNumber", None), "bokm": ("Bookmark", None), "%hlk": ("Hyperlink", None), "%clk": ("Field", None), "idxm": ("IndexMark", None),
}
#: What the payload of a drawing makes of it.
_DRAWN = {"ShapeComponentLine": "Line", "ShapeComponentRectangle": "Rect", "ShapeComponentEllipse": "Ellipse", "ShapeComponentArc": "Arc", "ShapeComponentPolygon": "Polygon", "ShapeComponentCurve": "Curve", "ShapeComponentOle": "OleObject", "ShapeComponentPicture": "Image"}


def body(section: int, found: list[Record]) -> dict[str, list[dict[str, Any]]]:
    """Paragraphs, controls, tables, cells and style runs of a section's records.

    Levels nest: a control belongs to the paragraph before it, a paragraph to
    the innermost control that lies above it, and a list header of a table
    begins a cell. A drawing with a list is a text box; otherwise its one
    payload names it.
    """
    out: dict[str, list[dict[str, Any]]] = {n: [] for n in ("paragraphs", "controls", "tables", "cells", "char_runs", "pages", "warnings")}
    open_controls: list[tuple[int, dict[str, Any]]] = []
    paragraph: dict[str, Any] | None = None
    table_of: dict[int, int] = {}
    cell_of: dict[int, dict[str, Any]] = {}
    inside: dict[int, list[dict[str, Any]]] = {}

    def owner(level: int) -> dict[str, Any] | None:
        while open_controls and open_controls[-1][0] >= level:
            open_controls.pop()
        return open_controls[-1][1] if open_controls else None

    for ordinal, r in enumerate(found):
        name = TAG_NAMES.get(r.tag)
        try:
            if name == "ParaHeader":
                held = owner(r.level)
                own = held["control"] if held is not None else None
                container = held["container"] if held is not None else "body"
                cell = cell_of.get(own) if own is not None else None
                shape = struct.unpack_from("<H", r.data, 8)[0] if len(r.data) >= 10 else 0
                style = r.data[10] if len(r.data) >= 11 else 0
                paragraph = {"section": section, "ordinal": len(out["paragraphs"]), "level": r.level, "container": container, "owner": own, "cell": cell["cell"] if cell else None, "para_shape": shape, "style": style, "text": ""}
                out["paragraphs"].append(paragraph)
                if cell is not None:
                    inside.setdefault(cell["cell"], []).append(paragraph)
            elif name == "ParaText" and paragraph is not None:
                paragraph["text"] = paragraph_text(r.data)
            elif name == "ParaCharShape" and paragraph is not None:
                out["char_runs"] += [{"section": section, "ordinal": paragraph["ordinal"], **x} for x in layouts.char_runs(r.data)]
            elif name == "CtrlHeader" and paragraph is not None:
                held = owner(r.level)
                letters = r.data[:4][::-1].decode("latin-1")
                kind, container = _CONTROLS.get(letters, (f"Unknown({letters})", f"unknown/{letters.strip()}/subList"))
                control = {"section": section, "control": len(out["controls"]), "kind": kind, "container": container, "anchor": paragraph["ordinal"], "owner": held["control"] if held is not None else None}
                out["controls"].append(control)
                open_controls.append((r.level, control))
            elif name == "Table" and (held := owner(r.level)) is not None:
                table_of[held["control"]] = len(out["tables"])
                out["tables"].append({"section": section, "table": len(out["tables"]), "control": held["control"], **layouts.table(r.data)})
            elif name == "ListHeader" and (held := owner(r.level)) is not None:
                if held["control"] in table_of:
                    cell = {"section": section, "table": table_of[held["control"]], "cell": len(out["cells"]), **layouts.cell(r.data)}
                    out["cells"].append({k: v for k, v in cell.items() if k != "margin"})
                    cell_of[held["control"]] = cell
                elif held["kind"] == "Shape":
                    held["kind"] = "TextBox"
            elif name in _DRAWN and (held := owner(r.level)) is not None and held["kind"] == "Shape":
                held["kind"] = _DRAWN[name]
            elif name == "PageDef":
                out["pages"].append({"section": section, **layouts.page(r.data)})
            elif name is None:
                out["warnings"].append({"code": 5100, "detail": f"section {section}: tag 0x{r.tag:04X} is not known"})
        except (ValueError, struct.error) as e:
            out["warnings"].append({"code": 5101, "detail": f"section {section}, record {ordinal}: {e}"})
    for n, held_in in inside.items():
        out["cells"][n] |= {"container": held_in[0]["container"], "text": "\n".join(p["text"] for p in held_in)}
    return out


def header(data: bytes) -> dict[str, Any]:
    """Version and flags of the file header, and what forbids reading on."""
    if not data.startswith(b"HWP Document File") or len(data) < 40:
        return {"version": None, "compressed": False, "problem": "signature"}
    version, flags = struct.unpack_from("<II", data, 32)
    problem = "password" if flags & 2 else "distribution" if flags & 4 else "version" if version >> 24 != 5 else None
    return {"version": f"{version >> 24}.{version >> 16 & 255}.{version >> 8 & 255}.{version & 255}", "compressed": bool(flags & 1), "problem": problem}


def parse(data: bytes, names: Sequence[str] | None = None) -> dict[str, list[dict[str, Any]]]:
    """Rows of entries, records, paragraphs and warnings of one file; records stay out where ``names`` leaves them out."""
    out: dict[str, list[dict[str, Any]]] = {n: [] for n in _PARTS}
    try:
        found = entries(data)
        out["entries"] = [{"path": e.path, "kind": e.kind, "size": len(e.data)} for e in found]
        streams = {e.path: e.data for e in found if e.kind == "Stream"}
        head = header(streams.get("FileHeader", b""))
        if head["problem"]:
            raise ValueError(head["problem"])
        sections = sorted((n for n in streams if n.startswith("BodyText/Section")), key=lambda n: int(n[16:] or 0))
        if len(sections) > LIMITS["sections"]:
            raise ValueError("too many sections")
        for name in [n for n in ("DocInfo",) if n in streams] + sections:
            found_records = list(records(inflate(streams[name]) if head["compressed"] else streams[name]))
            if names is None or "records" in names:
                out["records"] += [{"stream": name, "ordinal": i, "tag": r.tag, "level": r.level, "size": len(r.data), "data": r.data} for i, r in enumerate(found_records)]
            if name == "DocInfo":
                info, problems = layouts.read_info((r.tag, r.data) for r in found_records)
                out["fonts"] = layouts.fonts(info, LANGUAGES)
                out["char_shapes"] = [{"idx": x["idx"], "size": x["size"], "bold": x["bold"], "italic": x["italic"], "color": x["color"], "font": x["fonts"][0]} for x in info["CharShape"]]
                out["para_shapes"] = [{k: x[k] for k in ("idx", "alignment", "heading", "level")} for x in info["ParaShape"]]
                out["styles"] = [{k: x[k] for k in ("idx", "name", "english", "kind", "para_shape", "char_shape")} for x in info["Style"]]
                out["binaries"] = [{k: x[k] for k in ("idx", "kind", "id", "extension", "storage_name")} for x in info["BinData"]]
                out["warnings"] += [{"code": 5101, "detail": f"DocInfo: {p}"} for p in problems]
                out["warnings"] += [{"code": 5100, "detail": f"DocInfo: tag 0x{r.tag:04X} is not known"} for r in found_records if r.tag not in TAG_NAMES]
                continue
            for part, rows in body(sections.index(name), found_records).items():
                out[part] += rows
    except (ValueError, struct.error) as e:
        out["warnings"].append({"code": 5000, "detail": str(e)})
    return out


def record_rows(streams: DataFrame, id_col: str = "doc_id", data: str = "data") -> DataFrame:
    """(doc_id, ordinal, tag, level, data, text, error) of record streams; a stream that breaks off gives an error row behind its records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[Any, ...]] = []
            for doc, body in zip(batch["doc_id"], batch["data"], strict=True):
                n = 0
                try:
                    for n, r in enumerate(records(bytes(body) if body is not None else b""), 1):
                        text = paragraph_text(r.data) if TAG_NAMES.get(r.tag) == "ParaText" else None
                        out.append((doc, n - 1, r.tag, r.level, r.data, text, None))
                except ValueError as e:
                    out.append((doc, n, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "ordinal", "tag", "level", "data", "text", "error"]).astype({"ordinal": "Int32", "tag": "Int32", "level": "Int32"})

    rows = streams.select(F.col(id_col).cast("string").alias("doc_id"), F.col(data).cast("binary").alias("data"))
    return rows.mapInPandas(run, "doc_id string, ordinal int, tag int, level int, data binary, text string, error string")


def inflated(streams: DataFrame, data: str = "data") -> DataFrame:
    """Streams with what they expand to, or why they do not."""

    @F.pandas_udf("body binary, error string")
    def expand(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for body in bodies:
            try:
                out.append((inflate(bytes(body)), None))
            except (ValueError, TypeError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["body", "error"])

    return streams.withColumn("__x", expand(data)).select("*", "__x.body", "__x.error").drop("__x")


_PARTS = {
    "entries": "path: string, kind: string, size: bigint",
    "records": "stream: string, ordinal: int, tag: int, level: int, size: bigint, data: binary",
    "paragraphs": "section: int, ordinal: int, level: int, container: string, owner: int, cell: int, para_shape: int, style: int, text: string",
    "controls": "section: int, control: int, kind: string, container: string, anchor: int, owner: int",
    "tables": "section: int, table: int, control: int, rows: int, columns: int, page_break: string, repeat_header: boolean, cell_spacing: int, border_fill: int",
    "cells": "section: int, table: int, cell: int, paragraphs: int, column: int, row: int, col_span: int, row_span: int, width: int, height: int, vertical: string, is_header: boolean, border_fill: int, container: string, text: string",
    "char_runs": "section: int, ordinal: int, start: int, shape: int",
    "pages": "section: int, width: int, height: int, left: int, right: int, top: int, bottom: int, header: int, footer: int, gutter: int, landscape: boolean",
    "fonts": "language: string, idx: int, face: string",
    "char_shapes": "idx: int, size: int, bold: boolean, italic: boolean, color: int, font: int",
    "para_shapes": "idx: int, alignment: string, heading: string, level: int",
    "styles": "idx: int, name: string, english: string, kind: string, para_shape: int, char_shape: int",
    "binaries": "idx: int, kind: string, id: int, extension: string, storage_name: string",
    "warnings": "code: int, detail: string",
}


def decode(files: DataFrame, id_col: str = "path", content: str = "content", names: Sequence[str] | None = None) -> DataFrame:
    """One nested row for each file: arrays of the rows of the frames in ``names``, or of all.

    Rows go back as soon as there are ``columns.ROWS`` of them or their records
    fill ``columns.BYTES``.
    """
    wanted = list(names or _PARTS)
    kinds = {n: to_arrow_type(StructType.fromDDL(_PARTS[n])) for n in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(doc: str, data: bytes | None) -> tuple[dict[str, Any], int]:
            rows = parse(data or b"", wanted)
            return {"doc_id": doc} | {n: rows[n] for n in wanted}, sum(r["size"] for r in rows["records"])

        yield from columns.nested(batches, read, kinds)

    columns.bound(files.sparkSession)
    schema = "doc_id string, " + ", ".join(f"{n} array<struct<{_PARTS[n]}>>" for n in wanted)
    return files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, schema)


def frame(nested: DataFrame, name: str) -> DataFrame:
    return nested.select("doc_id", F.inline(name))


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path))


def tag_census(rows: DataFrame) -> DataFrame:
    """Records by tag, with the tag's name."""
    names = F.create_map(*[F.lit(x) for pair in TAG_NAMES.items() for x in pair])
    named = F.coalesce(F.try_element_at(names, F.col("tag")), F.format_string("Unknown(0x%04X)", "tag"))
    return rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("name", named)


def stream_sizes(rows: DataFrame) -> DataFrame:
    """Streams of each file with size and place by name, in the order of bytes."""
    streams = rows.filter("kind = 'Stream'")
    return streams.select("doc_id", "path", "size", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).alias("rank"))


def convert(nested: DataFrame) -> DataFrame:
    """(doc_id, content) packages of decoded files: body paragraphs, tables, notes, text boxes, headers and footers.

    A paragraph's table, its text and its first other control come out as one
    block each, in this order; a section without paragraphs gets an empty one.
    Files that could not be read give none.
    """
    from foliograph.sources.packages import CELL, CONTROL, encode

    keys = ["doc_id", "section"]
    paragraphs, controls = frame(nested, "paragraphs"), frame(nested, "controls")
    inner = paragraphs.filter("owner IS NOT NULL").groupBy(*keys, "owner", "cell").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("own"))
    inner = inner.select(*keys, "owner", "cell", F.array_join(F.transform("own", lambda p: p["text"]), "\n").alias("text"))
    cell = F.struct("row", "column", "col_span", "row_span", "is_header", "width", "height", "text").cast(CELL)
    cells = frame(nested, "cells").groupBy(*keys, "table").agg(F.collect_list(cell).alias("cells"))
    anchored = controls.filter("owner IS NULL").select(*keys, "control", "kind", "anchor")
    drawn = frame(nested, "tables").join(anchored, [*keys, "control"]).join(cells, [*keys, "table"])
    none = lambda kind: F.lit(None).cast(kind)
    tables = drawn.select(*keys, (F.col("anchor") * 4).alias("ordinal"), F.lit("").alias("text"), F.lit(0).alias("style"), "cells", none(CONTROL).alias("control"), F.col("control").alias("n"))
    texts = paragraphs.filter("container = 'body'").select(*keys, (F.col("ordinal") * 4 + 1).alias("ordinal"), F.replace("text", F.lit("\ufffc"), F.lit("")).alias("text"), "style", none(f"array<{CELL}>").alias("cells"), none(CONTROL).alias("control"), F.lit(0).alias("n"))
    noted = anchored.filter(F.col("kind").isin("Footnote", "Endnote", "TextBox", "Header", "Footer")).join(inner.select(*keys, F.col("owner").alias("control"), F.col("text").alias("inner")), [*keys, "control"])
    held = F.struct("kind", F.lit(1).alias("width"), F.lit(1).alias("height"), none("string").alias("detail"), none("string").alias("hint"), F.col("inner").alias("text"), none("array<struct<x: int, y: int>>").alias("points")).cast(CONTROL)
    notes = noted.select(*keys, (F.col("anchor") * 4 + 2).alias("ordinal"), F.lit("").alias("text"), F.lit(0).alias("style"), none(f"array<{CELL}>").alias("cells"), held.alias("control"), F.col("control").alias("n"))
    blocks = tables.unionByName(texts).unionByName(notes)
    numbered = blocks.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "n")))
    return encode(numbered.drop("n"))
