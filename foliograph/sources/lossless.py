"""Exact text form of a section: nested elements that lose nothing, and the way back."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

#: Which elements may hold which.
INSIDE = {
    "section": {"p"},
    "p": {"span", "table", "a", "img", "textbox", "footnote", "endnote", "line", "ellipse", "polygon", "dutmal", "compose", "control"},
    "table": {"tr"},
    "tr": {"td"},
    "td": {"p"},
    "textbox": {"p"},
    "footnote": {"p"},
    "endnote": {"p"},
    "ellipse": {"p"},
    "polygon": {"p"},
}


def write(node: dict[str, Any]) -> str:
    """A node has a name, attributes, and either text or nodes."""
    attributes = "".join(f" {k}={quoteattr(str(v))}" for k, v in sorted(node.get("attributes", {}).items()))
    inner = escape(node["text"]) if node.get("text") is not None else "".join(map(write, node.get("nodes", [])))
    return f"<{node['name']}{attributes}>{inner}</{node['name']}>"


def read(text: str) -> list[dict[str, Any]]:
    """Section nodes of a text; elements in a wrong place are errors."""
    root = ElementTree.fromstring(f"<document>{text}</document>")

    def node(e: ElementTree.Element, allowed: set[str]) -> dict[str, Any]:
        if e.tag not in allowed:
            raise ValueError(f"{e.tag} cannot stand here")
        own: dict[str, Any] = {"name": e.tag}
        if e.attrib:
            own["attributes"] = dict(e.attrib)
        if e.tag in INSIDE:
            if (e.text or "").strip() or any((k.tail or "").strip() for k in e):
                raise ValueError(f"text cannot stand in {e.tag}")
            own["nodes"] = [node(k, INSIDE[e.tag]) for k in e]
        else:
            own["text"] = "".join(e.itertext())
        return own

    return [node(e, {"section"}) for e in root]


# -- decoded packages ---------------------------------------------------------------------------------------------
def sections(rows: dict[str, list[dict[str, Any]]]) -> list[dict[str, Any]]:
    """Section nodes of one package's rows; nested paragraphs of controls and tables stand inside them."""
    tables = {t["path"]: t for t in rows["tables"]}
    cells: dict[int, list[dict[str, Any]]] = {}
    for c in rows["cells"]:
        cells.setdefault(c["table"], []).append(c)
    kinds = {c["control"]: c for c in rows["controls"]}
    owned: dict[int, list[dict[str, Any]]] = {}
    for p in rows["paragraphs"]:
        if p["owner"] is not None:
            owned.setdefault(p["owner"], []).append(p)
    runs: dict[tuple[int, int], list[dict[str, Any]]] = {}
    for r in rows["runs"]:
        runs.setdefault((r["section"], r["ordinal"]), []).append(r)

    def run(r: dict[str, Any]) -> dict[str, Any]:
        if r["kind"] == "text":
            return {"name": "span", "attributes": {"shape": r["char_shape"]}, "text": r["text"]}
        if r["kind"] == "image":
            return {"name": "img", "attributes": {"src": r["text"] or ""}, "text": ""}
        if r["kind"] == "table":
            own = cells.get(tables[f"{r['path']}.runs[{r['run']}]"]["table"], [])
            lines = [[c for c in own if c["row"] == n] for n in sorted({c["row"] for c in own})]
            td = lambda c: {"name": "td", "attributes": {"colspan": c["col_span"], "rowspan": c["row_span"]}, "nodes": [plain(x) for x in (c["text"] or "").split("\n")]}
            return {"name": "table", "nodes": [{"name": "tr", "nodes": [td(c) for c in line]} for line in lines]}
        c = kinds[r["control"]]
        name = c["kind"].lower()
        if name in INSIDE:
            return {"name": name, "nodes": [paragraph(p) for p in owned.get(c["control"], [])]}
        return {"name": "control", "attributes": {"kind": c["kind"], "width": c["width"], "height": c["height"]}, "text": c["detail"] or ""}

    def plain(text: str) -> dict[str, Any]:
        return {"name": "p", "nodes": [{"name": "span", "text": text}]}

    def paragraph(p: dict[str, Any]) -> dict[str, Any]:
        own = sorted(runs.get((p["section"], p["ordinal"]), []), key=lambda r: r["run"])
        return {"name": "p", "attributes": {"shape": p["para_shape"], "style": p["style"]}, "nodes": [run(r) for r in own]}

    body = [p for p in rows["paragraphs"] if p["container"] == "body"]
    return [{"name": "section", "nodes": [paragraph(p) for p in body if p["section"] == s["section"]]} for s in rows["sections"]]


def encode(files: DataFrame) -> DataFrame:
    """(doc_id, text) of packages (path, content); unreadable packages give no section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from foliograph.sources.packages import parse

        for batch in batches:
            texts = ["".join(map(write, sections(parse(bytes(c) if c is not None else b"")))) for c in batch["content"]]
            yield pd.DataFrame({"doc_id": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "doc_id string, text string")


def decode(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, section, ordinal, run, name, text, error) of the runs of lossless texts; an unreadable text is one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[Any, ...]] = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                try:
                    for s, section in enumerate(read(text or "")):
                        for o, p in enumerate(section["nodes"]):
                            out += [(doc, s, o, r, n["name"], n.get("text"), None) for r, n in enumerate(p["nodes"])]
                except (ValueError, ElementTree.ParseError) as e:
                    out.append((doc, None, None, None, None, None, str(e)))
            kinds = {"section": "Int32", "ordinal": "Int32", "run": "Int32"}
            yield pd.DataFrame(out, columns=["doc_id", "section", "ordinal", "run", "name", "text", "error"]).astype(kinds)

    rows = texts.selectExpr(f"CAST(`{id_col}` AS STRING) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInPandas(run, "doc_id string, section int, ordinal int, run int, name string, text string, error string")
