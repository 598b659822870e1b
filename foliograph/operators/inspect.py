"""Counts, censuses and summaries over document frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import semantic_text, trim
from foliograph.schema import TAG_NAMES


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of plain text: one row for each line, numbered from 0."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(id_col, *rest, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("ordinal", "text"))


def summarise(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """Paragraphs, those with visible text, characters, and the first visible text in document order."""
    seen = semantic_text("text")
    shown = seen != ""
    return paragraphs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.count_if(shown).alias("non_empty"),
        F.sum(F.length("text")).cast("long").alias("chars"),
        F.min_by(F.when(shown, seen), F.when(shown, F.col("ordinal"))).alias("first_text"),
    )


def totals(summary: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Sums by key and over all (null key), in one pass."""
    sums = [F.sum(m).cast("long").alias(m) for m in metrics]
    return summary.rollup(key).agg(*sums, F.count(F.lit(1)).alias("documents"))


def text_content(runs: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "text") -> DataFrame:
    """Text of the text runs of each paragraph, joined in order without separator."""
    own = F.when(F.col("kind") == kind, F.struct(*order, "text"))
    parts = F.array_sort(F.collect_list(own))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.count(F.lit(1)).alias("run_count"))


def content_counts(runs: DataFrame, *keys: str) -> DataFrame:
    """Tables, images and charts among the top-level runs of the body."""
    return runs.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("table", "image", "chart")])


def census(records: DataFrame, tag: str, level: str) -> DataFrame:
    """Count of each tag, with its distinct levels in order."""
    levels = F.array_sort(F.collect_set(level))
    return records.groupBy(tag).agg(F.count(F.lit(1)).alias("n"), F.array_join(levels.cast("array<string>"), ",").alias("levels"))


def snapshot(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by either key and by both, told apart by the grouping id, in one pass."""
    return rows.groupingSets([(first,), (second,), (first, second)], first, second).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def table_properties(cells: DataFrame, table: str, row: str, height: str, width: str, flag: Column) -> DataFrame:
    """By table: rows, cells, flagged cells, tallest cell, positive heights and widths as sorted distinct lists."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) > 0, F.col(c)))).cast("array<string>"), ",")
    return cells.groupBy(table).agg(
        F.countDistinct(row).alias("rows"),
        F.count(F.lit(1)).alias("cells"),
        F.count_if(flag).alias("flagged"),
        F.max(F.when(F.col(height) > 0, F.col(height))).alias("tallest"),
        listed(height).alias("heights"),
        listed(width).alias("widths"),
    )


def structure(cells: DataFrame, table: str, row: str, width: str, height: str) -> DataFrame:
    """By table: width of the first row, column count of the first row, and the tallest of each row in order."""
    rows = cells.groupBy(table, row).agg(
        F.sum(F.when(F.col(width) > 0, F.col(width))).alias("wide"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col(height) > 0, F.col(height))).alias("high")
    )
    highs = F.array_sort(F.collect_list(F.when(F.col("high").isNotNull(), F.struct(row, "high"))))
    return rows.groupBy(table).agg(
        F.min_by("wide", row).cast("long").alias("width"),
        F.min_by("n", row).alias("columns"),
        F.array_join(F.transform(highs, lambda x: x["high"].cast("string")), ",").alias("row_heights"),
    )


def first_positive(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first positive value of each key."""
    good = F.col(value) > 0
    return rows.groupBy(key).agg(F.min_by(F.when(good, F.col(value)), F.when(good, F.col(order))).alias(value), F.count(F.lit(1)).alias("n"))


def buckets(rows: DataFrame, key: str, by: str, values: Sequence[str]) -> DataFrame:
    """One count column for each value of ``by``."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(by) == v).alias(f"n_{v}") for v in values])


def unique_first(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct keys with the place of their first row."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first"))


def evidence(rows: DataFrame, key: str, kinds: dict[str, Column], verdicts: Sequence[tuple[Column, str]], otherwise: str) -> DataFrame:
    """Conditional sums and the first verdict that they support."""
    out = rows.groupBy(key).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    verdict = F.lit(otherwise)
    for test, name in reversed(verdicts):
        verdict = F.when(test, name).otherwise(verdict)
    return out.withColumn("assessment", verdict)


def stock_kind(series: Column, volume: Column) -> Column:
    """Stock chart by number of its own series and presence of a volume chart beside it."""
    return F.initcap(F.concat(F.when(volume, "v").otherwise(""), F.when(series >= 4, "ohlc").otherwise("hlc")))


def migration_report(files: DataFrame, size: str, text: str, limit: int) -> DataFrame:
    """Files by what becomes of them."""
    status = F.when(F.col(size) > limit, "skipped_too_large").when(trim(F.coalesce(F.col(text), F.lit(""))) == "", "failed").otherwise("success")
    return files.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("size"))


def path_inventory(pages: DataFrame, id_col: str, markup: str) -> DataFrame:
    """Count of each element of a markup column, by document."""
    names = F.transform(F.regexp_extract_all(F.col(markup), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    return pages.select(id_col, F.explode(names).alias("element")).groupBy(id_col, "element").agg(F.count(F.lit(1)).alias("n"))


def audit_snapshot(paragraphs: DataFrame, controls: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(doc_id, section, metric, key, other, n): counts of a parse by section, and by document where section is null.

    Paragraphs have a container and the kind of their owner, controls a
    container and a kind, unresolved items a container that may be null. All
    metrics are counted in one pass over grouping sets.
    """
    none = F.lit(None).cast("string")

    def tagged(df: DataFrame, metric: str, key: Column, other: Column = none) -> DataFrame:
        return df.select("doc_id", "section", F.lit(metric).alias("metric"), key.cast("string").alias("key"), other.cast("string").alias("other"))

    container = F.col("container")
    rows = tagged(paragraphs, "container", container).unionByName(tagged(controls, "container", container))
    for part in (
        tagged(paragraphs, "paragraph_container", container),
        tagged(controls, "control_container", container),
        tagged(unresolved, "unresolved_container", container),
        tagged(controls, "control", F.col("kind")),
        tagged(paragraphs.filter("owner_kind IS NOT NULL"), "container_owner", container, F.col("owner_kind")),
        tagged(controls, "container_control", container, F.col("kind")),
    ):
        rows = rows.unionByName(part)
    keys = [F.col(c) for c in ("doc_id", "metric", "key", "other")]
    return rows.groupingSets([[*keys, F.col("section")], keys], *keys, F.col("section")).agg(F.count(F.lit(1)).alias("n")).select("doc_id", "section", "metric", "key", "other", "n")


def with_emptiness(parents: DataFrame, children: DataFrame, on: Sequence[str]) -> DataFrame:
    """Parents with whether they have no child at all; blank children count."""
    there = children.select(*on).distinct().withColumn("__some", F.lit(True))
    return parents.join(there, list(on), "left").withColumn("is_empty", F.col("__some").isNull()).drop("__some")


def list_reference(kind: Column, level: Column, checked: Column) -> list[Column]:
    """heading, level and checked of a paragraph's list reference: outline, number, bullet, or a bullet to check."""
    heading = F.when(kind == "CheckBullet", "BULLET").when(kind.isin("Outline", "Number", "Bullet"), F.upper(kind)).otherwise("NONE")
    return [heading.alias("heading"), F.when(heading != "NONE", level).alias("level"), F.when(kind == "CheckBullet", checked).alias("checked")]


def content_summary(rows: DataFrame, doc: str, section: str, text: str) -> DataFrame:
    """Paragraphs, sections, characters and Markdown lines of each document."""
    return rows.groupBy(doc).agg(
        F.count(F.lit(1)).alias("paragraphs"), F.countDistinct(section).alias("sections"), F.sum(F.length(text)).cast("long").alias("chars"), F.sum(F.size(F.split(text, "\n"))).cast("long").alias("md_lines")
    )


def tag_ranges(tag: Column) -> list[Column]:
    """name, in_info and in_body of record tags."""
    names = F.create_map(*[F.lit(x) for pair in TAG_NAMES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, tag), F.format_string("Unknown(0x%04X)", tag))
    return [name.alias("name"), tag.between(16, 63).alias("in_info"), tag.between(66, 115).alias("in_body")]
