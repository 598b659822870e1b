"""Validation, integrity and audit: rules give issue rows, and never stop a job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import needs_inline_markup
from foliograph.schema import RULES


def issues(rows: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks, in one pass: keys, rule, code."""
    broken = [F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(RULES.get(name, 0)).alias("code"))) for name, test in rules.items()]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(found).alias("__i")).select(*keys, "__i.rule", "__i.code")


def first_issue(found: DataFrame, doc: str, order: Sequence[str]) -> DataFrame:
    """The first issue of each document in document order; the rest is not reported by a check that stops."""
    return found.groupBy(doc).agg(F.min_by(F.struct("rule", "code"), F.struct(*order)).alias("__f"), F.count(F.lit(1)).alias("issues")).select(
        doc, "__f.rule", "__f.code", "issues"
    )


def verdicts(docs: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """Every document with whether it is valid and its first issue."""
    return docs.join(found, doc, "left").withColumn("valid", F.col("code").isNull()).withColumn("error", F.concat(F.lit("E"), F.lpad(F.col("code").cast("string"), 4, "0")))


def duplicates(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Issue rows for ids that occur more than once."""
    return rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(label).alias("issue"), F.col("id").cast("string").alias("id"))


def dangling(rows: DataFrame, key: str, targets: DataFrame, target: str, label: str) -> DataFrame:
    """Issue rows for references to nothing."""
    own = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    return own.join(targets.select(F.col(target).alias("id")), "id", "left_anti").select(F.lit(label).alias("issue"), F.col("id").cast("string").alias("id"))


def integrity(*parts: DataFrame) -> DataFrame:
    """All issues once."""
    return reduce(DataFrame.unionByName, parts).distinct()


def audit(source: DataFrame, output: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two one-row summaries metric by metric: source, output, MATCH or DIFF."""

    def long(side: DataFrame, name: str) -> DataFrame:
        return side.select([F.col(m).cast("string").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", name)

    both = long(source, "source").join(long(output, "output"), "metric", "full_outer")
    return both.withColumn("status", F.when(F.col("source").eqNullSafe(F.col("output")), "MATCH").otherwise("DIFF"))


def checklist(summary: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Texts whose condition holds, in the order given."""
    lines = F.array(*[F.when(test, F.lit(text)) for text, test in texts.items()])
    return summary.withColumn("checklist", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "; "))


def span_rules() -> dict[str, Column]:
    """Rules of table cells."""
    return {"InvalidSpan": (F.col("col_span") < 1) | (F.col("row_span") < 1), "EmptyTableCell": F.coalesce(F.col("text"), F.lit("")) == ""}


def patch_guard(slots: DataFrame) -> DataFrame:
    """What stands in the way of patching text slots, first reason first; null where nothing does.

    Expects base and new path, text and hash of each slot.
    """
    reason = (
        F.when(F.col("path_base").isNull() | F.col("path_new").isNull(), "slot count differs")
        .when(F.col("path_base") != F.col("path_new"), "slot path differs")
        .when(F.col("hash_expected") != F.col("hash_base"), "base has changed")
        .when((F.col("text_base") != F.col("text_new")) & needs_inline_markup("text_new"), "inline markup needed")
    )
    return slots.withColumn("refused", reason).withColumn("changed", F.coalesce(F.col("text_base") != F.col("text_new"), F.lit(False)))


def graph_issues(frames: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, issue, a, b) of a legacy document's graph, each once: repeated ids, references to nothing, and summaries that differ.

    Frames: sections (section_id), paragraphs (paragraph_id, owner, control_ids,
    inline_control_ids, text, inline_text), controls (node_id, anchor), edges
    (from_id, to_id) and unresolved (item_id, section_id), all with doc_id. Every
    reference is an anti-join within its document.
    """
    sections, paragraphs, controls, edges, unresolved = (frames[n] for n in ("sections", "paragraphs", "controls", "edges", "unresolved"))

    def row(df: DataFrame, issue: str, a: str, b: str | None = None) -> DataFrame:
        return df.select("doc_id", F.lit(issue).alias("issue"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(None)).cast("long").alias("b"))

    def repeated(df: DataFrame, key: str, issue: str) -> DataFrame:
        return row(df.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), issue, key)

    def loose(df: DataFrame, own: str, ref: str, targets: DataFrame, key: str, issue: str) -> DataFrame:
        refs = df.filter(F.col(ref).isNotNull()).select("doc_id", F.col(own).alias("__a"), F.col(ref).alias("__b"))
        there = targets.select("doc_id", F.col(key).alias("__b")).distinct()
        return row(refs.join(there, ["doc_id", "__b"], "left_anti"), issue, "__a", "__b")

    held = paragraphs.select("doc_id", "paragraph_id", F.explode("control_ids").alias("control_id"))
    swapped = edges.select("doc_id", "from_id", "to_id")
    parts = [
        repeated(sections, "section_id", "DuplicateSectionId"),
        repeated(paragraphs, "paragraph_id", "DuplicateParagraphId"),
        repeated(controls, "node_id", "DuplicateControlId"),
        repeated(unresolved, "item_id", "DuplicateUnresolvedId"),
        row(paragraphs.filter(~F.col("text").eqNullSafe(F.col("inline_text"))), "ParagraphTextSummaryMismatch", "paragraph_id"),
        row(paragraphs.filter(~F.col("control_ids").eqNullSafe(F.col("inline_control_ids"))), "ParagraphControlInventoryMismatch", "paragraph_id"),
        loose(held, "paragraph_id", "control_id", controls, "node_id", "DanglingParagraphControlRef"),
        loose(paragraphs, "paragraph_id", "owner", controls, "node_id", "DanglingParagraphOwnerControlRef"),
        loose(controls, "node_id", "anchor", paragraphs, "paragraph_id", "DanglingControlAnchorParagraphRef"),
        loose(swapped, "to_id", "from_id", controls, "node_id", "DanglingControlEdgeFrom").select("doc_id", "issue", F.col("b").alias("a"), F.col("a").alias("b")),
        loose(swapped, "from_id", "to_id", controls, "node_id", "DanglingControlEdgeTo"),
        loose(unresolved, "item_id", "section_id", sections, "section_id", "DanglingUnresolvedSectionRef"),
    ]
    return integrity(*parts)
