"""Shallow and deep counts of decoded documents side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import trim


def deep_counts(paragraphs: DataFrame, runs: DataFrame, controls: DataFrame) -> DataFrame:
    """By section: body paragraphs, all paragraphs, tables, images and controls by kind.

    Recursion was paid for when the documents were read: a nested paragraph is
    a row whose container is not the body.
    """
    keys = ["doc_id", "section"]
    body = F.col("container") == "body"
    counted = paragraphs.groupBy(*keys).agg(F.count_if(body).alias("paragraphs"), F.count(F.lit(1)).alias("deep_paragraphs"))
    kinds = runs.groupBy(*keys).agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "image").alias("images"))
    named = controls.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("TextBox", "textboxes"), ("Line", "lines"), ("Polygon", "polygons"), ("Chart", "charts"), ("Ole", "ole"))])
    return counted.join(kinds, keys, "left").join(named, keys, "left").fillna(0)


def _lead(path: str = "path") -> Column:
    """The body run that a nested place is in."""
    return F.regexp_extract(path, r"^paragraphs\[[0-9]+\]\.runs\[[0-9]+\]", 0)


def _root(path: str = "path") -> Column:
    return F.regexp_extract(path, r"^paragraphs\[[0-9]+\]", 0)


def visible(paragraphs: DataFrame, runs: DataFrame, controls: DataFrame) -> DataFrame:
    """(doc_id, section, root, path, marginal, at, text): every text that can be seen, with the body paragraph it is in.

    Texts are those of runs and of links, trimmed and not blank; images have
    none. ``at`` orders them as they stand: the ordinals along the path.
    ``marginal`` tells texts of headers and footers, and of what is in them.
    """
    links = controls.filter("kind = 'Hyperlink'").select("doc_id", "section", "control", F.col("hint").alias("shown"))
    own = runs.join(links, ["doc_id", "section", "control"], "left").withColumn("text", trim(F.when(F.col("kind") == "text", F.col("text")).otherwise(F.col("shown"))))
    at = F.concat(F.regexp_extract_all("path", F.lit("([0-9]+)"), F.lit(1)).cast("array<int>"), F.array("run"))
    seen = own.filter("text <> ''").select("doc_id", "section", _root().alias("root"), _lead().alias("lead"), "path", at.alias("at"), "text")
    margins = paragraphs.filter("container IN ('header/subList', 'footer/subList')").select("doc_id", "section", _lead().alias("lead")).distinct().withColumn("marginal", F.lit(True))
    return seen.join(margins, ["doc_id", "section", "lead"], "left").withColumn("marginal", F.coalesce("marginal", F.lit(False))).drop("lead")


def summary(frames: dict[str, DataFrame]) -> DataFrame:
    """One row for each section: shallow and deep paragraphs, those with visible text, elements, and the first visible text.

    A body paragraph has visible text where it or anything in it has, headers
    and footers aside; the deep counts take in headers and footers. Rectangles
    are those that hold no text box.
    """
    keys = ["doc_id", "section"]
    paragraphs, controls = frames["paragraphs"], frames["controls"]
    seen = visible(paragraphs, frames["runs"], controls)
    counted = paragraphs.groupBy(*keys).agg(F.count_if(F.col("container") == "body").alias("paragraphs"), F.count(F.lit(1)).alias("deep_paragraphs"))
    inside = seen.filter("NOT marginal")
    shown = inside.groupBy(*keys).agg(F.countDistinct("root").alias("non_empty"), F.min_by("text", "at").alias("first_text"))
    # a paragraph that holds a visible paragraph has visible text itself
    holders = seen.select(*keys, F.explode(_prefixes(F.col("path"))).alias("holder")).distinct()
    deep_seen = paragraphs.join(holders, [paragraphs["doc_id"] == holders["doc_id"], paragraphs["section"] == holders["section"], paragraphs["path"] == holders["holder"]], "left_semi")
    deep_shown = deep_seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("deep_non_empty"))
    names = {"tbl": "tables", "pic": "images", "chart": "charts", "ole": "ole_objects", "drawText": "text_boxes", "line": "lines", "rect": "rects", "polygon": "polygons"}
    elements = frames["xml_paths"].groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in names.items()])
    out = frames["sections"].select(*keys, "has_header", "has_footer", "page_number", "landscape")
    for part in (counted, shown, deep_shown, elements):
        out = out.join(part, keys, "left")
    out = out.fillna(0, ["paragraphs", "deep_paragraphs", "non_empty", "deep_non_empty", *names.values()])
    return out.withColumn("rectangles", F.greatest(F.col("rects") - F.col("text_boxes"), F.lit(0).cast("long"))).drop("rects")


def _prefixes(path: Column) -> Column:
    """The paths of the paragraph at ``path`` and of all paragraphs around it."""
    parts = F.split(path, r"(?<=paragraphs\[[0-9]{1,9}\])(?=\.)")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))


def semantic_counts(controls: DataFrame, kind: str = "kind") -> DataFrame:
    """Controls of a legacy document's graph by kind; unknown tags that name a line, rectangle or polygon count as such."""
    k = F.col(kind)
    unknown = lambda part: k.startswith("Unknown(") & k.contains(part)
    first = F.when(unknown("line"), "Line").when(unknown("rect"), "Rect").when(unknown("polygon"), "Polygon").otherwise(k)
    names = {"Table": "tables", "Image": "images", "Chart": "charts", "OleObject": "ole_objects", "TextBox": "text_boxes", "Line": "lines", "Rect": "rectangles", "Polygon": "polygons"}
    has = {"Header": "has_header", "Footer": "has_footer", "PageNumber": "has_page_number"}
    return controls.withColumn("__k", first).groupBy("doc_id", "section").agg(
        *[F.count_if(F.col("__k") == n).alias(a) for n, a in names.items()], *[F.coalesce(F.bool_or(F.col("__k") == n), F.lit(False)).alias(a) for n, a in has.items()]
    )


def totals(sections: DataFrame) -> DataFrame:
    """One row for each document: sums over the rows of ``summary``, and how many sections have which parts."""
    sums = ("paragraphs", "non_empty", "deep_paragraphs", "tables", "images", "text_boxes", "ole_objects", "lines", "rectangles", "polygons")
    flags = {"headers": F.col("has_header"), "footers": F.col("has_footer"), "page_numbers": F.col("page_number").isNotNull(), "landscape": F.col("landscape")}
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), *[F.sum(c).alias(c) for c in sums], *[F.count_if(c).alias(n) for n, c in flags.items()])
