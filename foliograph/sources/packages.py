"""Word-processor packages (ZIP of XML parts) as document frames, and back.

A package is read by one call: its parts are few and small, and its tree is
flattened on the way into rows with their place (path, ordinal, container), so
that every later question is an operation over flat frames. A package that
cannot be read becomes a warning row and never stops the job.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliograph.schema import FRAMES, INTERESTING, LIMITS
from foliograph.sources import charts, columns

#: Contents of the mimetype entry.
MIMETYPES = ("application/hwp+zip", "application/haansofthwp+zip", "application/vnd.hancom.hwpx")
Rows = dict[str, list[dict[str, Any]]]
_SECTION = re.compile(r"Contents/section([0-9]+)\.xml\Z")
_MASTER = re.compile(r"Contents/masterpage([0-9]+)\.xml\Z")
#: Controls whose text is a sub-list of paragraphs.
_NESTED = {"rect": "TextBox", "footNote": "Footnote", "endNote": "Endnote", "ellipse": "Ellipse", "polygon": "Polygon"}
#: Controls without paragraphs of their own.
_SIMPLE = {"line": "Line", "arc": "Arc", "curve": "Curve", "connectLine": "ConnectLine", "equation": "Equation", "dutmal": "Dutmal", "compose": "Compose", "chart": "Chart", "ole": "Ole"}
#: The order in which the contents of a run count, whatever their order in the file.
_ORDER = "t tbl pic ctrl rect line ellipse arc polygon curve connectLine equation dutmal compose chart ole".split()
_INVENTORY = frozenset(INTERESTING)
_IN_CTRL = "header footer footNote endNote bookmark indexmark fieldBegin".split()
#: Types of fields that are kept as they are, and what the commands of summary fields stand for.
_FIELDS = ("CLICK_HERE", "DATE", "TIME", "PAGE_NUM", "DOC_SUMMARY", "USER_INFO")
_SUMMARY = {"$modifiedtime": "DATE", "$createtime": "TIME", "$lastsaveby": "USER_INFO"}


class Unreadable(ValueError):
    """A package that breaks a rule of the format; the first argument is the code."""


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _name(e: ElementTree.Element) -> str:
    return _local(e.tag)


def _kids(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [k for k in e if _local(k.tag) == name]


def _int(e: ElementTree.Element | None, key: str, default: int = 0) -> int:
    try:
        return int(e.get(key, default)) if e is not None else default
    except ValueError:
        return default


def text_of(t: ElementTree.Element) -> str:
    """Text of a run: breaks, tabs and spaces are elements; marks carry none."""
    inner = {"lineBreak": "\n", "tab": "\t", "fwSpace": " ", "nbSpace": "\u00a0"}
    return (t.text or "") + "".join(inner.get(_name(k), "") + (k.tail or "") for k in t)


def _plain_entries(data: bytes) -> tuple[dict[str, bytes], list[dict[str, Any]]] | None:
    """Contents and listing of an archive without any peculiarity; None leaves it, and all that is wrong, to ``zipfile``."""
    end = len(data) - 22
    if end < 0 or data[end : end + 4] != b"PK\5\6":
        return None
    disk, first_disk, here, count, size, at, comment = struct.unpack_from("<4H2IH", data, end + 4)
    if disk or first_disk or here != count or comment or at + size != end or count > LIMITS["entries"]:
        return None
    parts: dict[str, bytes] = {}
    listing, total = [], 0
    for _ in range(count):
        if at + 46 > end or data[at : at + 4] != b"PK\1\2":
            return None
        _, needs, flags, method, _, _, crc, packed, full, n_name, n_extra, n_comment, _, _, _, start = struct.unpack_from("<6H3I5H2I", data, at + 4)
        name = data[at + 46 : at + 46 + n_name]
        at += 46 + n_name + n_extra + n_comment
        if flags or needs > 20 or method not in (0, 8) or n_extra or 0xFFFFFFFF in (packed, full, start) or not name.isascii() or b"\0" in name or start + 30 > end:
            return None
        head = struct.unpack_from("<4s5H3I2H", data, start)
        body_at = start + 30 + head[9] + head[10]
        if head[0] != b"PK\3\4" or head[2] or head[3] != method or head[6:9] != (crc, packed, full) or data[start + 30 : start + 30 + head[9]] != name or body_at + packed > end:
            return None
        body = data[body_at : body_at + packed]
        if full > LIMITS["entry"] or total + full > LIMITS["total"] or method == 0 and packed != full:
            return None
        if method:
            reader = zlib.decompressobj(-15)
            try:
                body = reader.decompress(body, full + 1)
            except zlib.error:
                return None
            if not reader.eof or reader.unused_data:
                return None
        if len(body) != full or zlib.crc32(body) != crc:
            return None
        total += full
        path = name.decode()
        parts[path] = body
        listing.append({"path": path, "kind": "entry", "size": full, "compressed": packed})
    if at != end or parts.get("mimetype", b"").decode("utf-8", "replace").strip() not in MIMETYPES:
        return None
    return parts, listing


def read_entries(data: bytes) -> tuple[dict[str, bytes], list[dict[str, Any]]]:
    """Contents and listing of a package, under the limits on what comes out, not on what sizes claim."""
    if len(data) > LIMITS["file"]:
        raise Unreadable(4000, "file too large")
    plain = _plain_entries(data)
    if plain is not None:
        return plain
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable(4000, str(e)) from e
    infos = box.infolist()
    if len(infos) > LIMITS["entries"]:
        raise Unreadable(4000, "too many entries")
    parts: dict[str, bytes] = {}
    total = 0
    for info in infos:
        with box.open(info) as part:
            body = part.read(LIMITS["entry"] + 1)
        total += len(body)
        if len(body) > LIMITS["entry"] or total > LIMITS["total"]:
            raise Unreadable(4000, f"{info.filename} too large")
        parts[info.filename] = body
    if parts.get("mimetype", b"").decode("utf-8", "replace").strip() not in MIMETYPES:
        raise Unreadable(4001, "mimetype")
    return parts, [{"path": i.filename, "kind": "entry", "size": i.file_size, "compressed": i.compress_size} for i in infos]


def kids_of(e: ElementTree.Element) -> dict[str, ElementTree.Element]:
    return {_name(k): k for k in e}


def read_border(rows: Rows, e: ElementTree.Element, kids: dict[str, ElementTree.Element]) -> None:
    """A border fill: the type of each side, and what fills it."""
    sides = {side: kids[f"{side}Border"].get("type", "NONE") if f"{side}Border" in kids else None for side in ("left", "right", "top", "bottom")}
    brush = next((k for k in kids.get("fillBrush", ())), None)
    names = {"winBrush": "color", "gradation": "gradient", "imgBrush": "image"}
    kind = names.get(_name(brush)) if brush is not None else None
    image = next((k for k in brush.iter() if _name(k) == "img"), None) if brush is not None else None
    colour = brush.get("faceColor") if kind == "color" and brush is not None else None
    rows["borders"].append({"idx": _int(e, "id")} | sides | {"fill": kind, "color": colour, "image": image.get("binaryItemIDRef") if image is not None else None})


def read_master(rows: Rows, number: int, xml: bytes) -> None:
    """Paragraphs of a master page; an unknown type applies to both kinds of pages."""
    root = ElementTree.fromstring(xml)
    kind = root.get("type", "BOTH")
    for n, p in enumerate(e for e in root.iter() if _name(e) == "p"):
        text = "".join(text_of(t) for run in _kids(p, "run") for t in _kids(run, "t"))
        rows["masters"].append({"master": number, "type": kind if kind in ("BOTH", "EVEN", "ODD") else "BOTH", "ordinal": n, "para_shape": _int(p, "paraPrIDRef"), "text": text})


def read_chart(rows: Rows, name: str, xml: bytes) -> None:
    """A chart part: its kind, and each value of its series as a row."""
    found = charts.parse(xml)
    rows["charts"].append({"chart": name, "kind": found["kind"], "title": found["title"], "categories": len(found["categories"]), "series": len(found["series"])})
    for n, series in enumerate(found["series"]):
        values, xs, names = series.get("values", series.get("y", [])), series.get("x"), found["categories"]
        for point in range(max(len(values), len(xs or []))):
            at = lambda own: own[point] if own is not None and point < len(own) else None  # noqa: E731, B023
            rows["chart_points"].append({"chart": name, "series": n, "name": series["name"], "point": point, "category": at(names) if xs is None else None, "x": at(xs), "y": at(values)})


def read_header(rows: Rows, xml: bytes) -> None:
    """Fonts, border fills, character and paragraph shapes, tabs, numberings, bullets, styles, first numbers."""
    root = ElementTree.fromstring(xml)
    for face in (e for e in root.iter() if _name(e) == "fontface"):
        for font in _kids(face, "font"):
            rows["fonts"].append({"idx": _int(font, "id"), "language": face.get("lang", ""), "face": font.get("face", "")})
    hangul = {f["idx"]: f["face"] for f in rows["fonts"] if f["language"] == "HANGUL"}
    for e in root.iter():
        kind = _name(e)
        kids = kids_of(e) if kind in ("charPr", "paraPr") else {}
        if kind == "charPr":
            colour = e.get("textColor", "#000000").lstrip("#")
            bgr = int("".join(re.findall("..", colour)[::-1]), 16) if re.fullmatch("[0-9a-fA-F]{6}", colour) else 0
            line = lambda n, key, none: (kids[n].get(key, none) if n in kids else none)  # noqa: E731, B023
            rows["char_shapes"].append(
                {
                    "idx": _int(e, "id"), "font": hangul.get(_int(kids.get("fontRef"), "hangul")), "size": _int(e, "height", 1000), "bold": "bold" in kids,
                    "italic": "italic" in kids, "underline": line("underline", "type", "NONE"), "strikeout": line("strikeout", "shape", "NONE"), "color": bgr,
                }
            )
        elif kind == "paraPr":
            heading = kids.get("heading")
            margin = next((k for k in e.iter() if _name(k) == "left"), None)
            spacing = next((k for k in e.iter() if _name(k) == "lineSpacing"), None)
            align = kids["align"].get("horizontal", "LEFT").upper() if "align" in kids else "LEFT"
            rows["para_shapes"].append(
                {
                    "idx": _int(e, "id"), "alignment": "JUSTIFY" if align == "BOTH" else align, "heading": heading.get("type", "NONE") if heading is not None else "NONE",
                    "level": _int(heading, "level"), "indent": _int(margin, "value"), "line_spacing": _int(spacing, "value", 160),
                }
            )
        elif kind == "borderFill":
            read_border(rows, e, kids_of(e))
        elif kind == "tabPr":
            stops = [k for k in e.iter() if _name(k) == "tabItem"]
            for n, stop in enumerate(stops):
                rows["tabs"].append({"idx": _int(e, "id"), "stop": n, "position": _int(stop, "pos"), "type": stop.get("type", ""), "leader": stop.get("leader", "")})
        elif kind == "numbering":
            for head in _kids(e, "paraHead"):
                rows["numberings"].append({"idx": _int(e, "id"), "start": _int(e, "start"), "level": _int(head, "level"), "format": head.get("numFormat", ""), "text": head.text or ""})
        elif kind == "bullet":
            rows["bullets"].append({"idx": _int(e, "id"), "mark": e.get("char", ""), "checked_mark": e.get("checkedChar")})
        elif kind == "beginNum":
            rows["begins"].append({k: _int(e, k, 1) for k in ("page", "footnote", "endnote", "pic", "tbl", "equation")})
        elif kind == "style":
            rows["styles"].append({"idx": _int(e, "id"), "name": e.get("name", ""), "english": e.get("engName", ""), "para_shape": _int(e, "paraPrIDRef"), "char_shape": _int(e, "charPrIDRef")})


_HEADED = ("fonts", "char_shapes", "para_shapes", "borders", "tabs", "numberings", "bullets", "begins", "styles")


@lru_cache(64)
def _common_header(xml: bytes) -> Rows:
    rows: Rows = {name: [] for name in _HEADED}
    read_header(rows, xml)
    return rows


class _Section:
    """Rows of one section part; ``paths`` tells whether its path inventory is wanted."""

    def __init__(self, rows: Rows, index: int, paths: bool = True) -> None:
        self.rows, self.index, self.paragraphs, self.inventory, self.titles = rows, index, 0, paths, True

    def warn(self, code: int, detail: str) -> None:
        self.rows["warnings"].append({"code": code, "detail": f"section {self.index}: {detail}"})

    def paragraph(self, p: ElementTree.Element, path: str, container: str, owner: int | None, depth: int) -> None:
        if depth > LIMITS["depth"]:
            raise Unreadable(4005, "nesting too deep")
        place = {"section": self.index, "path": path}
        ordinal, self.paragraphs = self.paragraphs, self.paragraphs + 1
        titled = self.titles and any(_local(e.tag) == "titleMark" for e in p.iter())
        self.rows["paragraphs"].append(
            place
            | {
                "ordinal": ordinal, "container": container, "owner": owner, "para_shape": _int(p, "paraPrIDRef"), "style": _int(p, "styleIDRef"),
                "heading": 1 if titled else None, "page_break": p.get("pageBreak", "0") == "1",
            }
        )
        n = 0
        for run in _kids(p, "run"):
            for e in self.contents(run):
                n += self.run(e, place | {"ordinal": ordinal, "run": n, "char_shape": _int(run, "charPrIDRef")}, container, depth)

    def contents(self, run: ElementTree.Element) -> list[ElementTree.Element]:
        """What a run holds, in the fixed order of kinds; the text between the marks of a field belongs to the field."""

        def rank(e: ElementTree.Element) -> tuple[int, int]:
            name, first = _name(e), next((_name(k) for k in e), "")
            return _ORDER.index(name) if name in _ORDER else len(_ORDER), _IN_CTRL.index(first) if name == "ctrl" and first in _IN_CTRL else 0

        marks = {_name(k): k for c in _kids(run, "ctrl") for k in c}
        kept = sorted(run, key=rank)
        if "fieldBegin" in marks and "fieldEnd" in marks:
            marks["fieldBegin"].set("shown", "".join(text_of(t) for t in _kids(run, "t")))
            kept = [e for e in kept if _name(e) != "t"]
        return kept

    def run(self, e: ElementTree.Element, at: dict[str, Any], container: str, depth: int) -> int:
        kind, path = _name(e), f"{at['path']}.runs[{at['run']}]"
        if kind == "t":
            self.rows["runs"].append(at | {"kind": "text", "text": text_of(e), "control": None})
        elif kind == "tbl":
            self.rows["runs"].append(at | {"kind": "table", "text": None, "control": None})
            self.caption(e, path, None, depth)
            self.table(e, path, container, depth)
        elif kind == "pic":
            self.caption(e, path, None, depth)
            image = next((k for k in e.iter() if _name(k) == "img"), None)
            self.rows["runs"].append(at | {"kind": "image", "text": image.get("binaryItemIDRef") if image is not None else None, "control": None})
        elif kind == "ctrl":
            for k in e:
                if _name(k) in ("header", "footer"):
                    self.nested(k, path, f"{_name(k)}/subList", None, depth)
                elif _name(k) in _NESTED or _name(k) in ("bookmark", "indexmark", "fieldBegin"):
                    self.control(k, at, path, container, depth)
            return 1
        elif kind in _NESTED or kind in _SIMPLE:
            self.control(e, at, path, container, depth)
        elif kind == "secPr":
            self.page(e)
            return 0
        else:
            self.warn(4100, f"element {kind} is not known")
            return 0
        return 1

    def field(self, e: ElementTree.Element) -> tuple[str, str | None, str | None] | None:
        """(kind, detail, hint) of a field; None for a type that is not known."""
        own = {k.get("name"): k.text or "" for k in e.iter() if _name(k).endswith("Param")}
        kind = e.get("type", "")
        if kind == "HYPERLINK":
            return "Hyperlink", own.get("Path", ""), e.get("shown", "")
        if kind == "BOOKMARK":
            return "Bookmark", e.get("name"), None
        if kind in _FIELDS:
            return "Field", kind, own.get("Direction")
        if kind == "SUMMERY":
            return "Field", _SUMMARY.get(own.get("Command", ""), "DOC_SUMMARY"), None
        if kind == "CROSSREF":
            return "CrossRef", own.get("RefPath", "").lstrip("?#"), own.get("RefType")
        return ("Memo", None, None) if kind == "MEMO" else None

    def control(self, e: ElementTree.Element, at: dict[str, Any], path: str, container: str, depth: int) -> None:
        name, own = _name(e), {_name(k): k for k in e}
        script = next((k.text for k in e.iter() if _name(k) == "script"), None)
        chart = e.get("chartIDRef")
        detail, hint = script or e.get("name") or chart, None
        if name == "fieldBegin":
            field = self.field(e)
            if field is None:
                return
            kind, detail, hint = field
        elif name == "rect" and "drawText" not in own:
            kind = "Rect"
        elif name == "dutmal":
            kind, detail, hint = "Dutmal", *((own[k].text or "" if k in own else "") for k in ("mainText", "subText"))
        elif name == "compose":
            kind, detail = "Compose", e.get("composeText", "")
        else:
            kind = _NESTED.get(name) or _SIMPLE.get(name) or {"bookmark": "Bookmark", "indexmark": "IndexMark"}[name]
        size = next((k for k in e.iter() if _name(k) == "sz"), None)
        number = len(self.rows["controls"])
        self.rows["controls"].append(
            {"section": self.index, "control": number, "kind": kind, "container": container, "anchor": at["ordinal"], "width": _int(size, "width"), "height": _int(size, "height"), "detail": detail, "hint": hint}
        )
        corners = [(k, "x", "y") for k in e.iter() if _name(k) in ("pt", "startPt", "endPt")]
        corners += [(k, f"x{n}", f"y{n}") for k in e.iter() if _name(k) == "seg" for n in (1, 2)]
        self.rows["points"] += [{"section": self.index, "control": number, "point": n, "x": _int(k, x), "y": _int(k, y)} for n, (k, x, y) in enumerate(corners)]
        self.rows["runs"].append(at | {"kind": "control", "text": None, "control": number})
        self.caption(e, path, number, depth)
        self.nested(e, path, {"TextBox": "rect/drawText/subList"}.get(kind, f"{kind.lower()}/subList"), number, depth)

    def caption(self, e: ElementTree.Element, path: str, owner: int | None, depth: int) -> None:
        """The caption of a table, an image or a shape, whose paragraphs come before what is in it."""
        for k in _kids(e, "caption"):
            texts = ["".join(text_of(t) for t in p.iter() if _local(t.tag) == "t") for s in _kids(k, "subList") for p in _kids(s, "p")]
            self.rows["captions"].append({"section": self.index, "path": path, "side": k.get("side", "LEFT"), "gap": _int(k, "gap", 850), "text": "\n".join(texts)})
            self.nested(k, f"{path}.caption", "caption/subList", owner, depth)

    def nested(self, e: ElementTree.Element, path: str, container: str, owner: int | None, depth: int) -> None:
        for k in e:
            if _name(k) in ("subList", "drawText"):
                for i, p in enumerate(_kids(k, "p")):
                    self.paragraph(p, f"{path}.paragraphs[{i}]", container, owner, depth + 1)
                self.nested(k, path, container, owner, depth)

    def table(self, e: ElementTree.Element, path: str, container: str, depth: int) -> None:
        trs, number = _kids(e, "tr"), len(self.rows["tables"])
        if e.get("rowCnt") is not None and _int(e, "rowCnt") != len(trs):
            self.warn(4002, f"rowCnt {e.get('rowCnt')} for {len(trs)} rows")
        size = next(iter(_kids(e, "sz")), None)
        self.rows["tables"].append(
            {
                "table": number, "section": self.index, "path": path, "rows": len(trs), "width": _int(size, "width"), "page_break": e.get("pageBreak", "CELL"),
                "repeat_header": e.get("repeatHeader", "1") == "1", "cell_spacing": _int(e, "cellSpacing"), "border_fill": _int(e, "borderFillIDRef"),
            }
        )
        led = True
        for r, tr in enumerate(trs):
            cells = _kids(tr, "tc")
            flags = [c.get("header", "0") == "1" for c in cells]
            if any(flags) and not all(flags):
                self.warn(4003, f"row {r} mixes header and other cells")
            if cells and all(flags) and not led:
                self.warn(4004, f"header row {r} does not lead")
            led = led and bool(cells) and all(flags)
            for c, tc in enumerate(cells):
                kids = {_local(k.tag): k for k in tc}
                span, extent = kids.get("cellSpan"), kids.get("cellSz")
                texts = ["".join(text_of(t) for t in p.iter() if _local(t.tag) == "t") for s in _kids(tc, "subList") for p in _kids(s, "p")]
                self.rows["cells"].append(
                    {
                        "table": number, "row": r, "column": c, "col_span": _int(span, "colSpan", 1), "row_span": _int(span, "rowSpan", 1), "is_header": bool(cells) and all(flags),
                        "width": _int(extent, "width"), "height": _int(extent, "height"), "border_fill": _int(tc, "borderFillIDRef"), "text": "\n".join(texts) if texts else None,
                    }
                )
                self.nested(tc, f"{path}.table.rows[{r}].cells[{c}]", "table/tc/subList", None, depth)

    def page(self, e: ElementTree.Element) -> None:
        """Page settings; the first of a section counts."""
        own = self.rows["sections"][-1]
        if own["width"] is None:
            page = next((k for k in e.iter() if _name(k) == "pagePr"), None)
            margin = next((k for k in e.iter() if _name(k) == "margin"), None)
            own |= {"width": _int(page, "width"), "height": _int(page, "height"), "landscape": page is not None and page.get("landscape") == "NARROWLY"}
            own |= {k: _int(margin, k) for k in ("left", "right", "top", "bottom")}

    def read(self, xml: bytes) -> None:
        root = ElementTree.fromstring(xml)
        names: dict[str, ElementTree.Element] = {}
        counted = None
        for e in root.iter():
            names.setdefault(_local(e.tag), e)
            if counted is None and "masterPageCnt" in e.attrib:
                counted = e
        number, columns, self.titles = names.get("pageNum"), names.get("colPr"), "titleMark" in names
        self.rows["sections"].append(
            dict.fromkeys(("width", "height", "left", "right", "top", "bottom", "landscape"))
            | {"section": self.index, "has_header": "header" in names, "has_footer": "footer" in names, "page_number": number.get("pos") if number is not None else None, "columns": _int(columns, "colCount", 1)}
            | {"masters": _int(counted, "masterPageCnt")}
        )
        for i, p in enumerate(_kids(root, "p")):
            self.paragraph(p, f"paragraphs[{i}]", "body", None, 0)
        if self.inventory:
            self.paths(root)

    def paths(self, root: ElementTree.Element) -> None:
        ordinal = 0

        def walk(e: ElementTree.Element, path: str) -> None:
            nonlocal ordinal
            name = _name(e)
            here = f"{path}/{name}"
            if name in _INVENTORY:
                shown = (e.text or "").strip() or None
                self.rows["xml_paths"].append({"section": self.index, "ordinal": ordinal, "kind": name, "path": here, "ref_id": e.get("chartIDRef") or e.get("binaryItemIDRef"), "text": shown})
                ordinal += 1
            for k in e:
                walk(k, here)

        walk(root, "")


PARTS = (
    "sections", "paragraphs", "runs", "controls", "points", "tables", "cells", "captions", "charts", "chart_points", "masters", "char_shapes", "para_shapes", "styles",
    "fonts", "borders", "tabs", "numberings", "bullets", "begins", "entries", "xml_paths", "images", "warnings",
)


def parse(data: bytes, names: Sequence[str] = PARTS) -> Rows:
    """Rows of every frame for one package; problems are in ``warnings``. Frames that ``names`` leaves out may stay empty."""
    rows: Rows = {name: [] for name in PARTS}
    try:
        parts, rows["entries"] = read_entries(data)
        head = parts.get("Contents/header.xml")
        if head is not None and len(head) < 4096:
            rows |= {n: list(own) for n, own in _common_header(head).items()}  # most packages of a corpus share a few headers
        elif head is not None:
            read_header(rows, head)
        else:
            rows["warnings"].append({"code": 4001, "detail": "no header part"})
        numbered = sorted((int(m[1]), n) for n in parts if (m := _SECTION.match(n)))
        for i, (_, name) in enumerate(numbered):
            _Section(rows, i, "xml_paths" in names).read(parts[name])
        for number, name in sorted((int(m[1]), n) for n in parts if (m := _MASTER.match(n))):
            read_master(rows, number, parts[name])
        for name, body in parts.items():
            if name.startswith("Chart/") and name.endswith(".xml"):
                read_chart(rows, name, body)
            if name.startswith("BinData/"):
                key = "/".join(x for x in name[8:].split("/") if x and x != "..")
                extension = key.rpartition(".")[2].lower() if "." in key else ""
                rows["images"].append({"key": key, "format": extension, "data": body})
    except Unreadable as e:
        rows["warnings"].append({"code": e.args[0], "detail": e.args[1]})
    except (ElementTree.ParseError, zipfile.BadZipFile, OSError, EOFError, NotImplementedError, ValueError) as e:
        rows["warnings"].append({"code": 4002, "detail": str(e)})
    return rows


def _inner(name: str) -> list[str]:
    return [f.name for f in FRAMES[name].fields if f.name != "doc_id"]


@lru_cache
def _arrow(name: str) -> pa.StructType:
    return pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in FRAMES[name].fields if f.name != "doc_id"])


def _schema(names: Sequence[str]) -> str:
    fields = []
    for name in names:
        own = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in FRAMES[name].fields if f.name != "doc_id")
        fields.append(f"{name} array<struct<{own}>>")
    return "doc_id string, " + ", ".join(fields)


def decode(files: DataFrame, id_col: str = "path", content: str = "content", names: Sequence[str] = PARTS) -> DataFrame:
    """One nested row for each package: arrays of the rows of every frame in ``names``.

    Packages are read one at a time, and rows go back as soon as there are
    ``columns.ROWS`` of them or their images fill ``columns.BYTES``, so a worker
    holds that much and one package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {n: _arrow(n) for n in names}

        def read(doc: str, data: bytes | None) -> tuple[dict[str, Any], int]:
            rows = parse(data or b"", names)
            return {"doc_id": doc} | {n: rows[n] for n in names}, sum(len(r["data"]) for r in rows["images"])

        yield from columns.nested(batches, read, kinds)

    columns.bound(files.sparkSession)
    return files.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, _schema(names))


def frame(nested: DataFrame, name: str) -> DataFrame:
    """One frame of decoded packages; the other arrays are never read."""
    return nested.select("doc_id", F.explode(name).alias("__r")).select("doc_id", *[F.col(f"__r.{c}").alias(c) for c in _inner(name)])


def numbered(nested: DataFrame, name: str, other: str, number: str, values: Sequence[str]) -> DataFrame:
    """One frame with values of another whose rows it names by ``number``, which is their place in the package."""
    own = lambda r: F.element_at(other, r[number] + 1)
    whole = F.transform(name, lambda r: F.struct(*[r[c].alias(c) for c in _inner(name)], *[own(r)[v].alias(v) for v in values]))
    return nested.select("doc_id", F.explode(whole).alias("__r")).select("doc_id", "__r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path))


def sniff(files: DataFrame, content: str = "content") -> DataFrame:
    """Format by the first four bytes."""
    head = F.hex(F.substring(content, 1, 4))
    kind = F.when(head == "504B0304", "package").when(head == "D0CF11E0", "compound").otherwise("unknown")
    return files.withColumn("format", kind)


# -- writing ----------------------------------------------------------------------------------------------------
_HP = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph" xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section"'
_HH = 'xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head"'


def _t(text: str) -> str:
    marks = {"\n": "<hp:lineBreak/>", "\t": "<hp:tab/>", "\u00a0": "<hp:nbSpace/>"}
    return "<hp:t>" + "".join(marks.get(c) or escape(c) for c in text) + "</hp:t>"


def _p(text: str, para: int = 0, style: int = 0, extra: str = "") -> str:
    return f'<hp:p paraPrIDRef="{para}" styleIDRef="{style}"><hp:run charPrIDRef="0">{extra}{_t(text) if text else ""}</hp:run></hp:p>'


def _table(cells: list[dict[str, Any]]) -> str:
    rows: dict[int, list[dict[str, Any]]] = {}
    for c in sorted(cells, key=lambda c: (c["row"], c["column"])):
        rows.setdefault(c["row"], []).append(c)
    out = []
    for own in rows.values():
        tcs = [
            f'<hp:tc header="{int(bool(c.get("is_header")))}"><hp:subList>{_p(c.get("text") or "")}</hp:subList><hp:cellAddr colAddr="{c["column"]}" rowAddr="{c["row"]}"/>'
            f'<hp:cellSpan colSpan="{c.get("col_span") or 1}" rowSpan="{c.get("row_span") or 1}"/><hp:cellSz width="{c.get("width") or 0}" height="{c.get("height") or 0}"/></hp:tc>'
            for c in own
        ]
        out.append(f"<hp:tr>{''.join(tcs)}</hp:tr>")
    return f'<hp:tbl rowCnt="{len(rows)}">{"".join(out)}</hp:tbl>'


_SIZED = {"TextBox": "rect", "Rect": "rect", "Line": "line", "Ellipse": "ellipse", "Arc": "arc", "Polygon": "polygon", "Curve": "curve", "ConnectLine": "connectLine", "Equation": "equation", "Chart": "chart"}


def _control(c: dict[str, Any]) -> str:
    """A control, or a part of the page: kind, width, height, detail, hint, text of its paragraphs, and points."""
    kind, detail, hint, text = c["kind"], c.get("detail") or "", c.get("hint"), c.get("text")
    body = f"<hp:subList>{''.join(map(_p, text.split(chr(10))))}</hp:subList>" if text is not None else ""
    field = lambda name, **own: (
        f'<hp:ctrl><hp:fieldBegin type="{name}"><hp:parameters>{"".join(f"<hp:stringParam name={quoteattr(k)}>{escape(v)}</hp:stringParam>" for k, v in own.items() if v is not None)}</hp:parameters>{body}'
        f"</hp:fieldBegin></hp:ctrl>{_t(hint) if name == 'HYPERLINK' and hint else ''}<hp:ctrl><hp:fieldEnd/></hp:ctrl>"
    )
    if kind in ("Header", "Footer"):
        return f'<hp:ctrl><hp:{kind.lower()} applyPageType="BOTH">{body}</hp:{kind.lower()}></hp:ctrl>'
    if kind in ("Footnote", "Endnote"):
        name = {"Footnote": "footNote", "Endnote": "endNote"}[kind]
        return f"<hp:ctrl><hp:{name}>{body}</hp:{name}></hp:ctrl>"
    if kind == "PageNumber":
        return f"<hp:ctrl><hp:pageNum pos={quoteattr(detail)}/></hp:ctrl>"
    if kind == "Columns":
        return f"<hp:ctrl><hp:colPr colCount={quoteattr(detail)}/></hp:ctrl>"
    if kind == "Page":
        return f'<hp:secPr masterPageCnt="{detail or 0}"><hp:pagePr landscape="{hint or "WIDELY"}" width="{c["width"]}" height="{c["height"]}"><hp:margin left="8504" right="8504" top="5668" bottom="4252"/></hp:pagePr></hp:secPr>'
    if kind in ("Bookmark", "IndexMark"):
        return f"<hp:ctrl><hp:{kind.lower()} name={quoteattr(detail)}/></hp:ctrl>"
    if kind == "Hyperlink":
        return field("HYPERLINK", Path=detail)
    if kind == "CrossRef":
        return field("CROSSREF", RefPath=f"?#{detail}", RefType=hint)
    if kind == "Field":
        return field(detail, Direction=hint)
    if kind == "Memo":
        return field("MEMO")
    if kind == "Image":
        return f"<hp:pic><hp:img binaryItemIDRef={quoteattr(detail)}/></hp:pic>"
    if kind == "Dutmal":
        return f"<hp:dutmal><hp:mainText>{escape(detail)}</hp:mainText><hp:subText>{escape(hint or '')}</hp:subText></hp:dutmal>"
    if kind == "Compose":
        return f"<hp:compose composeText={quoteattr(detail)}/>"
    name = _SIZED[kind]
    corners = list(c["points"]) if c.get("points") is not None else []
    if kind in ("Line", "ConnectLine"):
        inner = "".join(f'<hp:{n}Pt x="{p["x"]}" y="{p["y"]}"/>' for n, p in zip(("start", "end"), corners, strict=False))
    elif kind == "Curve":
        inner = "".join(f'<hp:seg x1="{p["x"]}" y1="{p["y"]}" x2="{q["x"]}" y2="{q["y"]}"/>' for p, q in zip(corners[::2], corners[1::2], strict=False))
    else:
        inner = "".join(f'<hp:pt x="{p["x"]}" y="{p["y"]}"/>' for p in corners)
    if kind == "Equation":
        inner += f"<hp:script>{escape(detail)}</hp:script>"
    chart = f" chartIDRef={quoteattr(detail)}" if kind == "Chart" else ""
    body = f"<hp:drawText>{body}</hp:drawText>" if body else ""
    return f'<hp:{name}{chart}><hp:sz width="{c.get("width") or 0}" height="{c.get("height") or 0}"/>{inner}{body}</hp:{name}>'


#: Fixed value: the font of packages that name none.
BASE_FONT = "함초롬돋움"


@lru_cache(64)
def _packed(data: bytes) -> bytes:
    return _deflated(data)


def _deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def _archive(entries: list[tuple[str, bytes, bool]]) -> bytes:
    """A ZIP archive of (path, contents, whether deflated), all dated to the first day of the format."""
    if len(entries) > 0xFFFF or sum(len(d) for _, d, _ in entries) > 1 << 31:
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as out:
            for path, data, deflate in entries:
                out.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED)
        return box.getvalue()
    bodies, listing, at = [], [], 0
    for path, data, deflate in entries:
        name = path.encode()
        body = data if not deflate else _packed(data) if len(data) < 2048 else _deflated(data)
        common = struct.pack("<5H3I2H", 20, 0 if name.isascii() else 0x800, 8 if deflate else 0, 0, 33, zlib.crc32(data), len(body), len(data), len(name), 0)
        bodies += [b"PK\3\4", common, name, body]
        listing.append(b"PK\1\2" + struct.pack("<H", 0x314) + common + struct.pack("<3H2I", 0, 0, 0, 0o600 << 16, at) + name)
        at += 30 + len(name) + len(body)
    directory = b"".join(listing)
    return b"".join([*bodies, directory, b"PK\5\6", struct.pack("<4H2IH", 0, 0, len(entries), len(entries), len(directory), at, 0)])


@lru_cache(64)
def _head(styles: tuple[str, ...], font: str) -> str:
    named = "".join(f'<hh:style id="{i}" type="PARA" name={quoteattr(s)} engName={quoteattr(s)} paraPrIDRef="0" charPrIDRef="0"/>' for i, s in enumerate(styles))
    return (
        f'<hh:refList><hh:fontfaces><hh:fontface lang="HANGUL"><hh:font id="0" face={quoteattr(font)}/></hh:fontface></hh:fontfaces>'
        '<hh:charProperties><hh:charPr id="0" height="1000" textColor="#000000"><hh:fontRef hangul="0"/></hh:charPr></hh:charProperties>'
        f'<hh:paraProperties><hh:paraPr id="0"><hh:align horizontal="LEFT"/></hh:paraPr></hh:paraProperties><hh:styles>{named}</hh:styles></hh:refList>'
    )


def build(sections: list[list[dict[str, Any]]], parts: dict[str, bytes] | None = None, styles: list[str] = ["Normal"], font: str = BASE_FONT) -> bytes:  # noqa: B006
    """A package of sections and further parts by path; a block has text, style, a control, and, for a table, cells."""
    parts = dict(parts or {})
    lists = parts.pop("refList", None)  # the lists of the header, where they are given
    head = lists.decode() if lists is not None else _head(tuple(styles), font)
    out = [("mimetype", MIMETYPES[0].encode(), False), ("Contents/header.xml", f'<hh:head {_HH} secCnt="{len(sections)}">{head}</hh:head>'.encode(), True)]
    for i, blocks in enumerate(sections):
        if f"Contents/section{i}.xml" not in parts:
            body = "".join(_p(b.get("text") or "", 0, b.get("style") or 0, (_table(b["cells"]) if b.get("cells") else "") + (_control(b["control"]) if b.get("control") else "")) for b in blocks)
            out.append((f"Contents/section{i}.xml", f"<hs:sec {_HP}>{body}</hs:sec>".encode(), True))
    out += [(path, data, False) for path, data in sorted(parts.items())]
    items = "".join(f'<opf:item id="section{i}" href="Contents/section{i}.xml"/>' for i in range(len(sections)))
    index = f'<opf:package xmlns:opf="http://www.idpf.org/2007/opf/"><opf:metadata><opf:title/></opf:metadata><opf:manifest>{items}</opf:manifest></opf:package>'
    return _archive([*out, ("Contents/content.hpf", index.encode(), True)])


CELL = "struct<row: int, column: int, col_span: int, row_span: int, is_header: boolean, width: int, height: int, text: string>"
CONTROL = "struct<kind: string, width: int, height: int, detail: string, hint: string, text: string, points: array<struct<x: int, y: int>>>"


def encode(blocks: DataFrame, parts: DataFrame | None = None, font: str = BASE_FONT) -> DataFrame:
    """(doc_id, content) packages of blocks (doc_id, section, ordinal, text, style, cells, control).

    The last three may be missing. ``parts`` (doc_id, path, data) are further
    parts of the packages: images, charts, master pages, whole sections, or as
    ``refList`` the lists of the header.
    """
    absent = {"style": F.lit(0), "cells": F.lit(None).cast(f"array<{CELL}>"), "control": F.lit(None).cast(CONTROL)}
    rows = blocks.withColumns({k: v for k, v in absent.items() if k not in blocks.columns})
    own = F.struct(F.col("section").cast("int").alias("section"), F.col("ordinal").cast("long").alias("ordinal"), "text", "style", "cells", "control")
    whole = rows.groupBy("doc_id").agg(F.collect_list(own).alias("blocks"))
    more = F.lit(None).cast("array<struct<path: string, data: binary>>").alias("parts")
    if parts is not None:
        of = parts.groupBy("doc_id").agg(F.collect_list(F.struct("path", F.col("data").cast("binary").alias("data"))).alias("parts"))
        whole = whole.join(of, "doc_id", "left")
    else:
        whole = whole.select("*", more)
    return encode_whole(whole, font)


def encode_whole(files: DataFrame, font: str = BASE_FONT) -> DataFrame:
    """(doc_id, content) packages of rows (doc_id, blocks, parts) that hold all blocks of a package.

    Every row becomes a package where it is; nothing is gathered. What blocks
    and parts are is as in ``encode``; parts may be missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, row in columns.rows(batches, "blocks"):
            sections: dict[int, list[dict[str, Any]]] = {}
            for b in sorted(row["blocks"], key=lambda b: (b["section"], b["ordinal"])):
                sections.setdefault(b["section"], []).append(b)
            extra = {x["path"]: x["data"] for x in row["parts"]} if row.get("parts") is not None else None
            yield doc, build(list(sections.values()), extra, font=font)

    columns.bound(files.sparkSession)
    return files.mapInArrow(lambda batches: columns.files(run(batches)), "doc_id string, content binary")
