"""Structural validation of decoded packages: every broken rule is a row, in document order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.operators import order
from foliograph.operators.rules import first_issue, verdicts
from foliograph.schema import RULES
from foliograph.sources.charts import POINTS

_PLACE = ["doc_id", "section", "ordinal", "item"]


def _rows(df: DataFrame, rule: str, section: Column | None = None, ordinal: Column | None = None, item: Column | None = None) -> DataFrame:
    place = [(x if x is not None else F.lit(0)).cast("int") for x in (section, ordinal, item)]
    return df.select("doc_id", *[c.alias(n) for c, n in zip(place, _PLACE[1:], strict=True)], F.lit(rule).alias("rule"), F.lit(RULES[rule]).alias("code"))


def issues(docs: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, section, ordinal, item, rule, code) of the body's top level.

    ``docs`` names every document. Text of cells and text boxes is not gone
    into, and headers and footers are not looked at.
    """
    body = frames["paragraphs"].filter("container = 'body'")
    runs, tables, cells, controls = (frames[n] for n in ("runs", "tables", "cells", "controls"))
    place = runs.filter("kind = 'table'").select("doc_id", "section", "ordinal", F.concat(F.col("path"), F.lit(".runs["), F.col("run").cast("string"), F.lit("]")).alias("path"))
    own = tables.join(place, ["doc_id", "section", "path"]).join(body.select("doc_id", "section", "ordinal"), ["doc_id", "section", "ordinal"], "left_semi")
    inside = cells.join(own.select("doc_id", "table", "section", "ordinal"), ["doc_id", "table"])
    by_row = inside.groupBy("doc_id", "table", "section", "ordinal", "row").agg(F.bool_and("is_header").alias("is_header"))
    filled = by_row.groupBy("doc_id", "table").agg(F.count(F.lit(1)).alias("filled"))
    led = order.leading_headers(by_row, ["doc_id", "table"], ["row"], F.col("is_header")).filter("misplaced")
    anchored = controls.filter("container = 'body'").withColumn("ordinal", F.col("anchor"))
    nested = frames["paragraphs"].filter("owner IS NOT NULL").select("doc_id", F.col("owner").alias("control")).distinct()
    hollow = anchored.join(nested, ["doc_id", "control"], "left_anti")
    s, o, c = F.col("section"), F.col("ordinal"), F.col("control")
    charts, points = frames["charts"], frames["chart_points"]
    corners = frames["points"].groupBy("doc_id", "control").agg(F.count(F.lit(1)).alias("corners"))
    crooked = anchored.filter("kind = 'Polygon'").join(corners, ["doc_id", "control"], "left").filter("coalesce(corners, 0) < 3")
    drawn = anchored.filter("kind = 'Chart'").join(charts.select("doc_id", F.col("chart").alias("detail"), F.col("kind").alias("plot"), "categories", "series"), ["doc_id", "detail"], "left")
    uneven = points.groupBy("doc_id", F.col("chart").alias("detail"), "series").agg((F.count("x") != F.count("y")).alias("uneven")).filter("uneven").select("doc_id", "detail").distinct()
    by_points = F.col("plot").isin(*POINTS)
    flat = anchored.filter(F.col("kind").isin("Ellipse", "Polygon", "Chart", "Equation") & ((F.col("width") <= 0) | (F.col("height") <= 0)))
    parts = [
        _rows(docs.join(frames["sections"], "doc_id", "left_anti"), "EmptyDocument"),
        _rows(frames["sections"].join(body, ["doc_id", "section"], "left_anti"), "EmptySection", s),
        _rows(body.join(runs, ["doc_id", "section", "ordinal"], "left_anti"), "EmptyParagraph", s, o),
        _rows(own.filter("rows = 0"), "EmptyTable", s, o, F.col("table")),
        _rows(own.filter("rows > 0").join(filled, ["doc_id", "table"], "left").filter("coalesce(filled, 0) < rows"), "EmptyTableRow", s, o, F.col("table")),
        _rows(led, "NonLeadingTableHeaderRow", s, o, F.col("table")),
        _rows(inside.filter("col_span < 1 OR row_span < 1"), "InvalidSpan", s, o, F.col("table")),
        _rows(inside.filter("text IS NULL"), "EmptyTableCell", s, o, F.col("table")),
        _rows(hollow.filter("kind = 'TextBox'"), "EmptyTextBox", s, o, c),
        _rows(hollow.filter("kind = 'Footnote'"), "EmptyFootnote", s, o, c),
        _rows(hollow.filter("kind = 'Endnote'"), "EmptyEndnote", s, o, c),
        _rows(crooked, "InvalidPolygon", s, o, c),
        _rows(drawn.filter("coalesce(series, 0) = 0"), "EmptyChart", s, o, c),
        _rows(drawn.filter((F.col("series") > 0) & ~by_points & (F.col("categories") == 0)), "EmptyCategories", s, o, c),
        _rows(drawn.filter(by_points).join(uneven, ["doc_id", "detail"], "left_semi"), "SeriesLengthMismatch", s, o, c),
        _rows(flat, "InvalidShapeSize", s, o, c),
        _rows(anchored.filter("kind = 'Equation' AND coalesce(trim(detail), '') = ''"), "EmptyEquation", s, o, c),
    ]
    return reduce(DataFrame.unionByName, parts)


def validate(docs: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """Every document: whether it is valid, and its first issue in document order."""
    return verdicts(docs.select("doc_id"), first_issue(issues(docs, frames), "doc_id", ["section", "ordinal", "item", "code"]), "doc_id")
