"""JSON exchange of documents and sections, and style templates in a subset of YAML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.schema import LIMITS

RUN = "struct<kind: string, text: string, char_shape: int>"
PARAGRAPH = f"struct<ordinal: int, para_shape: int, style: int, heading: int, page_break: boolean, runs: array<{RUN}>>"
SECTION = f"struct<section: int, paragraphs: array<{PARAGRAPH}>>"
DOCUMENT = f"struct<version: int, sections: array<{SECTION}>>"


def documents(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, document) nested documents of the body's paragraphs and runs."""
    run = F.struct("run", "kind", "text", "char_shape")
    own = runs.groupBy("doc_id", "section", "ordinal").agg(
        F.transform(F.array_sort(F.collect_list(run)), lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text"), r["char_shape"].alias("char_shape"))).alias("runs")
    )
    body = paragraphs.filter("container = 'body'").join(own, ["doc_id", "section", "ordinal"], "left")
    empty = F.array().cast(f"array<{RUN}>")
    paragraph = F.struct("ordinal", "para_shape", "style", "heading", "page_break", F.coalesce("runs", empty).alias("runs"))
    sections = body.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(paragraph), lambda a, b: a["ordinal"] - b["ordinal"]).alias("paragraphs"))
    whole = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "paragraphs")), lambda a, b: a["section"] - b["section"]).alias("sections"))
    return whole.select("doc_id", F.struct(F.lit(1).alias("version"), "sections").alias("document"))


def to_json(docs: DataFrame, section: int | None = None, inline_limit: int | None = None) -> DataFrame:
    """(doc_id, json, error): the document or one section; over the limit the text stays out and the error says so."""
    value = F.col("document") if section is None else F.try_element_at(F.col("document.sections"), F.lit(section + 1))
    text = F.to_json(value)
    out = docs.select("doc_id", text.alias("json"), F.when(value.isNull(), "section out of range").alias("error"))
    if inline_limit is not None:
        over = F.octet_length("json") > inline_limit
        out = out.select("doc_id", F.when(~over, F.col("json")).alias("json"), F.when(over, "too large").otherwise(F.col("error")).alias("error"))
    return out


def from_json(rows: DataFrame, text: str = "json") -> DataFrame:
    """(doc_id, document, error) of exported documents; unreadable texts are error rows."""
    parsed = rows.withColumn("document", F.from_json(text, DOCUMENT))
    bad = F.col("document").isNull() | F.col("document.sections").isNull()
    return parsed.select("doc_id", "document", F.when(bad, "not an exported document").alias("error"))


def flat_runs(docs: DataFrame) -> DataFrame:
    """Run rows of nested documents."""
    sections = docs.select("doc_id", F.explode("document.sections").alias("s"))
    paragraphs = sections.select("doc_id", F.col("s.section").alias("section"), F.explode("s.paragraphs").alias("p"))
    return paragraphs.select("doc_id", "section", F.col("p.ordinal").alias("ordinal"), F.posexplode("p.runs").alias("run", "r")).select("doc_id", "section", "ordinal", "run", "r.*")


def json_schema(ddl: str = DOCUMENT) -> str:
    return T.StructType.fromDDL(f"value {ddl}").fields[0].dataType.json()


# -- templates --------------------------------------------------------------------------------------------------
def _scalar(text: str) -> Any:
    if text in ("", "~", "null"):
        return None
    if text[0] in "\"'" and text[-1] == text[0] and len(text) > 1:
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x.strip()) for x in text[1:-1].split(",")] if text[1:-1].strip() else []
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def read_yaml(text: str) -> Any:
    """Maps, lists and scalars by indentation: the part of YAML that templates use."""
    lines = [(len(x) - len(x.lstrip(" ")), re.sub(r"\s+#.*$", "", x).strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]
    at = 0

    def block(depth: int) -> Any:
        nonlocal at
        made: Any = None
        while at < len(lines) and lines[at][0] == depth:
            body = lines[at][1]
            if body.startswith("- ") or body == "-":
                made = [] if made is None else made
                rest = body[1:].strip()
                if re.match(r"[\w.-]+:(\s|\Z)", rest):
                    lines[at] = (depth + 2, rest)
                    made.append(block(depth + 2))
                else:
                    at += 1
                    made.append(_scalar(rest) if rest else deeper(depth))
                continue
            if isinstance(made, list):
                break
            key, colon, rest = body.partition(":")
            if not colon:
                raise ValueError(f"no key in {body!r}")
            made = {} if made is None else made
            at += 1
            made[key.strip().strip("\"'")] = _scalar(rest.strip()) if rest.strip() else deeper(depth)
        return made

    def deeper(depth: int) -> Any:
        if at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("-")):
            return block(lines[at][0])
        return None

    out = block(lines[0][0]) if lines else None
    if at < len(lines):
        raise ValueError(f"cannot place {lines[at][1]!r}")
    return out


def merge(child: Any, parent: Any) -> Any:
    """Maps field by field, everything else from the child where it is set."""
    if isinstance(child, dict) and isinstance(parent, dict):
        return {k: merge(child.get(k), parent.get(k)) for k in [*parent, *(k for k in child if k not in parent)]}
    return parent if child is None else child


def overlay(child: list[dict[str, Any]], parent: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Definitions by id, the child's over the parent's, in the order of ids."""
    found = {d["id"]: d for d in [*(parent or []), *(child or [])]}
    return [found[k] for k in sorted(found)]


def resolve(templates: dict[str, dict[str, Any]], name: str) -> dict[str, Any]:
    """A template with all it inherits; chains that return to themselves, are too long or lead nowhere are errors."""
    chain: list[str] = []
    at: str | None = name
    while at is not None:
        if at in chain:
            raise ValueError(f"{at} inherits from itself")
        if at not in templates:
            raise ValueError(f"no template {at}")
        if len(chain) >= LIMITS["inheritance"]:
            raise ValueError("inheritance too deep")
        chain.append(at)
        at = (templates[at].get("meta") or templates[at]).get("extends")
    out: dict[str, Any] = {}
    for link in chain:
        parent = templates[link]
        lists = {k: overlay(out.get(k), parent.get(k)) for k in ("tabs", "numberings", "bullets") if out.get(k) or parent.get(k)}
        page = out.get("page") if out.get("page") is not None else parent.get("page")
        out = merge(out, parent) | lists | ({"page": page} if page is not None else {})
    return out


def template_styles(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, name, extends, style, font, size, error) of YAML templates, a row for each style; an unreadable one is an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[Any, ...]] = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                try:
                    found = read_yaml(text) or {}
                    meta = found.get("meta") or {}
                    for style, own in (found.get("styles") or {}).items():
                        out.append((doc, meta.get("name"), meta.get("extends"), style, (own or {}).get("font"), (own or {}).get("size"), None))
                except (ValueError, AttributeError, TypeError) as e:
                    out.append((doc, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "name", "extends", "style", "font", "size", "error"]).astype({"size": "Int32"})

    texts = rows.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(run, "doc_id string, name string, extends string, style string, font string, size int, error string")
