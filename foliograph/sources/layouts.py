"""Fixed-layout records of legacy documents: styles, shapes, binary data, table cells.

Each reader takes a record's payload and gives a row; a payload that is too
short is an error for the caller to report.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from typing import Any

from foliograph.operators.shapes import PAGE_BREAKS, VERTICAL
from foliograph.schema import TAG_NAMES

Row = dict[str, Any]
#: Alignments by code, and the bit that marks a header cell.
ALIGNMENTS = {0: "JUSTIFY", 1: "LEFT", 2: "RIGHT", 3: "CENTER"}
HEADINGS = {0: "NONE", 1: "OUTLINE", 2: "NUMBER", 3: "BULLET"}
HEADER_CELL = 1 << 18


def _need(data: bytes, n: int) -> None:
    if len(data) < n:
        raise ValueError(f"record has {len(data)} of {n} bytes")


def _string(data: bytes, at: int) -> tuple[str, int]:
    """A length-prefixed UTF-16 string and where it ends."""
    _need(data, at + 2)
    (n,) = struct.unpack_from("<H", data, at)
    _need(data, at + 2 + 2 * n)
    return data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"), at + 2 + 2 * n


def _name(code: int, names: dict[int, str]) -> str:
    return names.get(code, f"Unknown({code})")


def id_mappings(data: bytes) -> Row:
    counts = struct.unpack(f"<{len(data) // 4}i", data[: len(data) // 4 * 4])
    return {"counts": list(counts)}


def binary_data(data: bytes) -> Row:
    _need(data, 2)
    (flags,) = struct.unpack_from("<H", data)
    kind = {0: "Link", 1: "Embedding", 2: "Storage"}.get(flags & 15, f"Unknown({flags & 15})")
    if kind == "Link":
        return {"kind": kind, "id": None, "extension": None, "storage_name": None}
    _need(data, 4)
    (number,) = struct.unpack_from("<H", data, 2)
    extension = _string(data, 4)[0] if len(data) > 4 else ""
    return {"kind": kind, "id": number, "extension": extension, "storage_name": f"BIN{number:04X}.{extension}"}


def face_name(data: bytes) -> Row:
    _need(data, 3)
    return {"face": _string(data, 1)[0]}


def char_shape(data: bytes) -> Row:
    _need(data, 56)
    fonts = list(struct.unpack_from("<7H", data))
    size, flags = struct.unpack_from("<iI", data, 42)
    (colour,) = struct.unpack_from("<I", data, 52)
    return {"fonts": fonts, "size": size if size > 0 else 1000, "italic": bool(flags & 1), "bold": bool(flags & 2), "underline": flags >> 2 & 3, "strikeout": bool(flags >> 18 & 7), "color": colour & 0xFFFFFF}


def para_shape(data: bytes) -> Row:
    _need(data, 12)
    flags, left, right = struct.unpack_from("<Iii", data)
    return {"alignment": ALIGNMENTS.get(flags >> 2 & 7, "LEFT"), "heading": HEADINGS[flags >> 23 & 3], "level": flags >> 25 & 7, "left": left, "right": right}


def style(data: bytes) -> Row:
    name, at = _string(data, 0)
    english, at = _string(data, at)
    _need(data, at + 8)
    kind, following, language, para, char = struct.unpack_from("<BBhHH", data, at)
    return {"name": name, "english": english, "kind": "CHAR" if kind & 7 == 1 else "PARA", "next": following, "language": language if language >= 0 else 1042, "para_shape": para, "char_shape": char}


def char_runs(data: bytes) -> list[Row]:
    """Positions and shapes of a paragraph's style runs; eight bytes each."""
    if len(data) % 8:
        raise ValueError("style runs are cut")
    return [{"start": a, "shape": b} for a, b in struct.iter_unpack("<II", data)]


def page(data: bytes) -> Row:
    _need(data, 40)
    names = ("width", "height", "left", "right", "top", "bottom", "header", "footer", "gutter")
    return dict(zip(names, struct.unpack_from("<9i", data), strict=True)) | {"landscape": bool(data[36] & 1)}


def table(data: bytes) -> Row:
    if len(data) < 8:
        return {"rows": 0, "columns": 0, "page_break": "None", "repeat_header": False, "cell_spacing": 0, "border_fill": None}
    flags, rows, columns = struct.unpack_from("<IHH", data)
    spacing = struct.unpack_from("<h", data, 8)[0] if len(data) >= 10 else 0
    at = 18 + 2 * rows
    border = struct.unpack_from("<H", data, at)[0] if len(data) >= at + 2 else 0
    return {"rows": rows, "columns": columns, "page_break": _name(flags & 3, PAGE_BREAKS), "repeat_header": bool(flags & 4), "cell_spacing": spacing, "border_fill": border or None}


def cell(data: bytes) -> Row:
    """A table cell; the older form of thirty bytes counts its paragraphs in two bytes."""
    _need(data, 30)
    (paragraphs, flags), rest = (struct.unpack_from("<HI", data), data[6:]) if len(data) == 30 else (struct.unpack_from("<II", data), data[8:])
    _need(rest, 24)
    column, row, col_span, row_span, width, height = struct.unpack_from("<4H2i", rest)
    left, right, top, bottom = struct.unpack_from("<4h", rest, 16)
    border = struct.unpack_from("<H", rest, 24)[0] if len(rest) >= 26 else 0
    return {
        "paragraphs": paragraphs, "column": column, "row": row, "col_span": max(col_span, 1), "row_span": max(row_span, 1), "width": width, "height": height,
        "margin": [left, right, top, bottom], "vertical": _name(flags >> 5 & 3, VERTICAL), "is_header": bool(flags & HEADER_CELL), "border_fill": border or None,
    }


READERS: dict[str, Callable[[bytes], Row]] = {
    "IdMappings": id_mappings,
    "BinData": binary_data,
    "FaceName": face_name,
    "CharShape": char_shape,
    "ParaShape": para_shape,
    "Style": style,
    "PageDef": page,
    "Table": table,
}


def read_info(records: Iterable[tuple[int, bytes]]) -> tuple[dict[str, list[Row]], list[str]]:
    """Rows by kind, numbered in order, and what could not be read."""
    out: dict[str, list[Row]] = {k: [] for k in READERS}
    problems = []
    for tag, data in records:
        name = TAG_NAMES.get(tag)
        if name in READERS:
            try:
                out[name].append({"idx": len(out[name])} | READERS[name](data))
            except ValueError as e:
                problems.append(f"{name}: {e}")
    return out, problems


def fonts(info: dict[str, list[Row]], languages: tuple[str, ...]) -> list[Row]:
    """Fonts by language as the id counts slice them; where they do not add up, every font in every language."""
    faces = [f["face"] for f in info["FaceName"]]
    counts = info["IdMappings"][0]["counts"][1 : 1 + len(languages)] if info["IdMappings"] else []
    if counts and sum(counts) == len(faces) and min(counts) >= 0:
        out, at = [], 0
        for language, n in zip(languages, counts, strict=False):
            out += [{"language": language, "idx": i, "face": f} for i, f in enumerate(faces[at : at + n])]
            at += n
        return out
    return [{"language": language, "idx": i, "face": f} for language in languages for i, f in enumerate(faces or ["함초롬바탕"])]


def grid(records: Iterable[tuple[int, int, bytes]], text: Callable[[bytes], str]) -> list[list[Row]]:
    """Tables of a record stream (tag, level, data): their cells with text, nested tables apart."""
    found: list[list[Row]] = []
    open_tables: list[tuple[int, list[Row]]] = []
    for tag, level, data in records:
        name = TAG_NAMES.get(tag)
        while open_tables and level < open_tables[-1][0]:
            open_tables.pop()
        if name == "Table":
            found.append([])
            open_tables.append((level, found[-1]))
        elif name == "ListHeader" and open_tables and level == open_tables[-1][0]:
            open_tables[-1][1].append(cell(data) | {"text": None})
        elif name == "ParaText" and open_tables and open_tables[-1][1]:
            own = open_tables[-1][1][-1]
            own["text"] = text(data) if own["text"] is None else own["text"] + "\n" + text(data)
    return found
