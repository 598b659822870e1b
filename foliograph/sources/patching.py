"""Text patches of packages that leave every other byte as it was.

The text slots of a section are found with their byte spans; changed texts are
put in their place from the last to the first. A patch names the hash that the
section had when it was exported, and nothing is changed where it differs.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from typing import Any, NamedTuple
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_FACE = re.compile(r"""(<(?:\w+:)?font\b[^>]*?\bface=)("[^"]*"|'[^']*')""")


class Slot(NamedTuple):
    path: str
    text: str
    start: int
    end: int
    plain: bool  # no element inside


class Refused(ValueError):
    """Why a patch is not applied."""


def text_slots(xml: bytes) -> list[Slot]:
    """Text elements in document order with paths of ordinals and the byte spans of their contents."""
    parser = expat.ParserCreate()
    stack: list[tuple[str, dict[str, int]]] = [("", {})]
    slots: list[Slot] = []
    open_text: list[Any] = []
    names = {"p": "paragraphs", "run": "runs", "tbl": "table", "tr": "rows", "tc": "cells", "t": "text"}

    def start(tag: str, _: dict[str, str]) -> None:
        name = tag.rpartition(":")[2]
        if open_text:
            open_text[0][2] = False
        n = stack[-1][1].setdefault(name, 0)
        stack[-1][1][name] += 1
        step = f".{names[name]}[{n}]" if name in names else ""
        stack.append((stack[-1][0] + step, {}))
        if name == "t" and not open_text:
            head = xml.index(b">", parser.CurrentByteIndex) + 1
            if xml[head - 2 : head - 1] != b"/":
                open_text.append([stack[-1][0][1:], head, True, []])

    def end(tag: str) -> None:
        path, _ = stack.pop()
        if open_text and tag.rpartition(":")[2] == "t" and open_text[0][0] == path[1:]:
            own = open_text.pop()
            slots.append(Slot(own[0], "".join(own[3]), own[1], parser.CurrentByteIndex, own[2]))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: open_text[0][3].append(data) if open_text else None
    parser.Parse(xml, True)
    return slots


def export(data: bytes, section: int) -> dict[str, Any]:
    """Hash and text slots of a section."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        name = f"Contents/section{section}.xml"
        if name not in box.namelist():
            raise Refused("section out of range")
        xml = box.read(name)
    return {"section": section, "sha256": hashlib.sha256(xml).hexdigest(), "slots": [{"path": s.path, "text": s.text} for s in text_slots(xml)]}


def patch(data: bytes, section: int, sha256: str, texts: dict[str, str]) -> bytes:
    """The package with new texts in a section; without a change the same bytes.

    Refused are: a section that is not there, a section that has changed, a
    path that is no slot, a slot with elements inside, and a new text that
    would need an element.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        name = f"Contents/section{section}.xml"
        if name not in box.namelist():
            raise Refused("section out of range")
        xml = box.read(name)
        if hashlib.sha256(xml).hexdigest() != sha256:
            raise Refused("base has changed")
        slots = {s.path: s for s in text_slots(xml)}
        changed = []
        for path, text in texts.items():
            if path not in slots:
                raise Refused(f"no slot {path}")
            if text != slots[path].text:
                if not slots[path].plain or any(c in text for c in "\n\t\u00a0"):
                    raise Refused(f"inline markup in {path}")
                changed.append((slots[path].start, slots[path].end, escape(text).encode()))
        if not changed:
            return data
        for start, end, new in sorted(changed, reverse=True):
            xml = xml[:start] + new + xml[end:]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as target:
            for info in box.infolist():
                target.writestr(info, xml if info.filename == name else box.read(info))
    return out.getvalue()


def apply(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, content, error): packages with their changes (doc_id, section, sha256, path, text).

    A package with a refused change keeps its bytes, and the error says why.
    """
    own = changes.groupBy("doc_id", "section", "sha256").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("texts"))
    own = own.groupBy("doc_id").agg(F.collect_list(F.struct("section", "sha256", "texts")).alias("sections"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, errors = [], []
            for content, sections in zip(batch["content"], batch["sections"], strict=True):
                made, error = bytes(content), None
                try:
                    for s in sections if sections is not None else []:
                        made = patch(made, s["section"], s["sha256"], dict(s["texts"]))
                except (Refused, zipfile.BadZipFile, expat.ExpatError) as e:
                    made, error = bytes(content), str(e)
                contents.append(made)
                errors.append(error)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": contents, "error": pd.Series(errors, dtype="object")})

    joined = files.select(F.col("path").alias("doc_id"), "content").join(own, "doc_id", "left")
    return joined.mapInPandas(run, "doc_id string, content binary, error string")


def with_font(data: bytes, face: str) -> bytes:
    """The package with another face for its first font, wherever that stands in the header."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        if "Contents/header.xml" not in box.namelist():
            raise Refused("no header part")
        xml = box.read("Contents/header.xml").decode()
        first = _FACE.search(xml)
        if first is None:
            return data
        new = _FACE.sub(lambda m: f"{m[1]}{quoteattr(face)}" if m[2] == first[2] else m[0], xml)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as target:
            for info in box.infolist():
                target.writestr(info, new.encode() if info.filename == "Contents/header.xml" else box.read(info))
    return out.getvalue()


def restyle(files: DataFrame, face: str) -> DataFrame:
    """(doc_id, content, error): packages with another face for their first font; one that cannot be read keeps its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[Any, bytes, str | None]] = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    out.append((doc, with_font(bytes(content), face), None))
                except (Refused, zipfile.BadZipFile, UnicodeDecodeError) as e:
                    out.append((doc, bytes(content), str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "content", "error"]).astype({"error": "object"})

    return files.select(F.col("path").alias("doc_id"), "content").mapInPandas(run, "doc_id string, content binary, error string")
