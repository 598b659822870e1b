"""Markdown as document frames: block structure line by line, inline text reduced to plain text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.schema import LIMITS

#: A comment of this form alone on a line starts the next section, whoever wrote it.
SECTION = re.compile(r"<!-- [\w-]+:section -->\Z")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)\Z")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_ITEM = re.compile(r"( *)(?:([-*+])|([0-9]{1,9})[.)])[ \t]+(?:\[([ xX])\][ \t]+)?(.*)\Z")
_DIVIDER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_CODE = re.compile(r"(`+)(.+?)\1")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
_LINK = re.compile(r"\[((?:[^\]\\]|\\.)*)\]\(([^)\s]*)[^)]*\)")
_STRONG = re.compile(r"(\*\*\*|\*\*|\*|~~)(?=\S)(.+?)(?<=\S)\1|(?<!\w)(__|_)(?=\S)(.+?)(?<=\S)\3(?!\w)")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def inline(text: str) -> tuple[str, list[tuple[str, str]], list[str]]:
    """(plain text, links as (text, url), image paths); formats are dropped and the text of images too."""
    images = [m[2] for m in _IMAGE.finditer(text)]
    text = _IMAGE.sub("", text)
    links: list[tuple[str, str]] = []

    def link(m: re.Match[str]) -> str:
        if re.match("(?i)(https?://|mailto:)|\\Z", m[2]):
            links.append((m[1], m[2]))
        return m[1]

    text = _LINK.sub(link, text)
    held: list[str] = []

    def hold(body: str) -> str:
        held.append(body)
        return f"\x00{len(held) - 1}\x00"

    text = _CODE.sub(lambda m: hold(m[2].strip(" ") or m[2]), text)
    text = _ESCAPED.sub(lambda m: hold(m[1]), text)
    while (shorter := _STRONG.sub(lambda m: m[2] or m[4], text)) != text:
        text = shorter
    return re.sub("\x00([0-9]+)\x00", lambda m: held[int(m[1])], text), links, images


def cells(line: str) -> list[str]:
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


def blocks(text: str, keep_header: bool = False) -> list[dict[str, Any]]:
    """Blocks in order: section, kind, level, text, and the rows of a table.

    A table's first line, its header, is dropped as the reader this follows
    does, unless ``keep_header``; a table of a header alone is one empty cell.
    """
    out: list[dict[str, Any]] = []
    lines, at, section, open_section = text.lstrip("\ufeff").replace("\r\n", "\n").split("\n"), 0, 0, False
    paragraph: list[str] = []

    def add(kind: str, body: str, level: int | None = None, **more: Any) -> None:
        nonlocal open_section
        open_section = True
        out.append({"section": section, "kind": kind, "level": level, "text": body, "checked": None, "rows": None, "links": None} | more)

    def close() -> None:
        if paragraph:
            joined = " ".join(x.strip() for x in paragraph) if not any(x.endswith("  ") or x.endswith("\\") for x in paragraph) else ""
            if not joined:
                parts = [x.rstrip("\\").strip() + ("\n" if x.endswith(("  ", "\\")) else " ") for x in paragraph]
                joined = "".join(parts).strip()
            plain, links, images = inline(joined)
            add("paragraph", plain, links=[u for _, u in links], images=images)
            paragraph.clear()

    while at < len(lines):
        line = lines[at]
        at += 1
        if SECTION.match(line.strip()):
            close()
            section, open_section = section + open_section, False
        elif m := _FENCE.match(line):
            close()
            body = []
            while at < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*\Z", lines[at]):
                body.append(lines[at])
                at += 1
            at += 1
            add("code", "\n".join(body))
        elif m := _HEADING.match(line):
            close()
            add("heading", inline(m[2] or "")[0], len(m[1]))
        elif not paragraph and _RULE.match(line):
            add("rule", "---")
        elif line.lstrip().startswith(">"):
            close()
            body = [line]
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                body.append(lines[at])
                at += 1
            add("quote", inline(" ".join(x.lstrip()[1:].strip() for x in body))[0])
        elif m := _ITEM.match(line):
            close()
            kind = "bullet" if m[2] else "number"
            add(kind, inline(m[5])[0], min(len(m[1]) // 2, 9), checked=None if m[4] is None else m[4] in "xX")
        elif "|" in line and at < len(lines) and _DIVIDER.match(lines[at]) and "-" in lines[at]:
            close()
            rows = [cells(line)]
            at += 1
            while at < len(lines) and "|" in lines[at] and lines[at].strip():
                rows.append(cells(lines[at]))
                at += 1
            rows = rows if keep_header else rows[1:] or [[""]]
            width = min(max(map(len, rows)), LIMITS["columns"])
            add("table", "", rows=[[inline(c)[0] for c in r[:width]] + [""] * (width - len(r)) for r in rows])
        elif not line.strip():
            close()
        else:
            paragraph.append(line)
    close()
    return out


SCHEMA = "doc_id string, section int, ordinal int, kind string, level int, text string, checked boolean, rows array<array<string>>, links array<string>"


def decode(docs: DataFrame, id_col: str, text_col: str, keep_header: bool = False) -> DataFrame:
    """Blocks of Markdown texts, one row each; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for i, b in enumerate(blocks(text, keep_header) if text is not None else []):
                    out.append({"doc_id": doc, "ordinal": i} | {k: b[k] for k in ("section", "kind", "level", "text", "checked", "rows", "links")})
            frame = pd.DataFrame(out, columns=["doc_id", "section", "ordinal", "kind", "level", "text", "checked", "rows", "links"])
            yield frame.astype({"level": "Int32"}) if len(frame) else frame

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA)


def encode(rows: DataFrame, marker: str = "<!-- foliograph:section -->") -> DataFrame:
    """(doc_id, markdown) of block rows, in the JVM."""
    from foliograph.operators.render import document

    plain = lambda c: F.regexp_replace(c, r"([\\*_`\[\]~#])", r"\\$1")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(plain(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    lines = F.transform(F.coalesce("rows", F.array(F.array(F.lit("")))), line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.col("rows")[0])))
    pad = F.repeat(F.lit("  "), F.coalesce("level", F.lit(0)))
    text = F.when(F.col("kind").isin("code", "rule"), F.col("text")).otherwise(plain(F.col("text")))
    block = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), text))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "number", F.concat(pad, F.lit("1. "), text))
        .when(F.col("checked").isNotNull(), F.concat(pad, F.when(F.col("checked"), "- [x] ").otherwise("- [ ] "), text))
        .when(F.col("kind") == "bullet", F.concat(pad, F.lit("- "), text))
        .when(F.col("kind") == "table", F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))
        .otherwise(text)
    )
    return document(rows.withColumn("__block", block), "doc_id", "section", "ordinal", "__block", marker)
