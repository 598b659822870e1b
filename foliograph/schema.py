"""Frames of the document model and the code tables that go with them.

Recursion is paid for once, when documents are read: every paragraph, run,
cell and control is a row with its place, and deep questions are filters and
aggregations over flat frames.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "double": T.DoubleType()}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


FRAMES: dict[str, T.StructType] = {
    "sections": _struct("doc_id string, section int, width int, height int, left int, right int, top int, bottom int, landscape boolean, has_header boolean, has_footer boolean, page_number string, columns int, masters int"),
    "paragraphs": _struct("doc_id string, section int, path string, ordinal int, container string, owner int, para_shape int, style int, heading int, page_break boolean"),
    "runs": _struct("doc_id string, section int, path string, ordinal int, run int, kind string, text string, char_shape int, control int"),
    "controls": _struct("doc_id string, section int, control int, kind string, container string, anchor int, width int, height int, detail string, hint string"),
    "points": _struct("doc_id string, section int, control int, point int, x int, y int"),
    "captions": _struct("doc_id string, section int, path string, side string, gap int, text string"),
    "charts": _struct("doc_id string, chart string, kind string, title string, categories int, series int"),
    "chart_points": _struct("doc_id string, chart string, series int, name string, point int, category string, x double, y double"),
    "masters": _struct("doc_id string, master int, type string, ordinal int, para_shape int, text string"),
    "borders": _struct("doc_id string, idx int, left string, right string, top string, bottom string, fill string, color string, image string"),
    "tabs": _struct("doc_id string, idx int, stop int, position int, type string, leader string"),
    "numberings": _struct("doc_id string, idx int, start int, level int, format string, text string"),
    "bullets": _struct("doc_id string, idx int, mark string, checked_mark string"),
    "begins": _struct("doc_id string, page int, footnote int, endnote int, pic int, tbl int, equation int"),
    "tables": _struct("doc_id string, table int, section int, path string, rows int, width int, page_break string, repeat_header boolean, cell_spacing int, border_fill int"),
    "cells": _struct("doc_id string, table int, row int, column int, col_span int, row_span int, is_header boolean, width int, height int, border_fill int, text string"),
    "char_shapes": _struct("doc_id string, idx int, font string, size int, bold boolean, italic boolean, underline string, strikeout string, color int"),
    "para_shapes": _struct("doc_id string, idx int, alignment string, heading string, level int, indent int, line_spacing int"),
    "styles": _struct("doc_id string, idx int, name string, english string, para_shape int, char_shape int"),
    "fonts": _struct("doc_id string, idx int, language string, face string"),
    "entries": _struct("doc_id string, path string, kind string, size long, compressed long"),
    "xml_paths": _struct("doc_id string, section int, ordinal int, kind string, path string, ref_id string, text string"),
    "records": _struct("doc_id string, stream string, ordinal int, tag int, level int, size long, data binary"),
    "images": _struct("doc_id string, key string, format string, data binary"),
    "warnings": _struct("doc_id string, code int, detail string"),
}

#: Elements that a path inventory lists.
INTERESTING = (
    "p run tbl tr tc pic img chart ole rect line ellipse polygon arc curve connectLine drawText equation container"
).split()
#: Languages of a font list, in the order they are written.
LANGUAGES = ("HANGUL", "LATIN", "HANJA", "JAPANESE", "OTHER", "SYMBOL", "USER")
#: Names of the record tags, from each range's first number on.
INFO_TAGS = (
    16,
    "DocumentProperties IdMappings BinData FaceName BorderFill CharShape TabDef Numbering Bullet ParaShape Style DocData "
    "DistributeDocData Reserved CompatibleDocument LayoutCompatibility TrackChange".split(),
)
BODY_TAGS = (
    66,
    "ParaHeader ParaText ParaCharShape ParaLineSeg ParaRangeTag CtrlHeader ListHeader PageDef FootnoteShape PageBorderFill "
    "ShapeComponent Table ShapeComponentLine ShapeComponentRectangle ShapeComponentEllipse ShapeComponentArc "
    "ShapeComponentPolygon ShapeComponentCurve ShapeComponentOle ShapeComponentPicture ShapeComponentContainer CtrlData Equation".split(),
)
TAG_NAMES = {first + i: name for first, names in (INFO_TAGS, BODY_TAGS) for i, name in enumerate(names)}
#: Validation rules and their codes.
RULES = {
    "EmptyDocument": 2000,
    "EmptySection": 2001,
    "EmptyParagraph": 2002,
    "EmptyTable": 2003,
    "EmptyTableRow": 2004,
    "InvalidSpan": 2005,
    "EmptyTextBox": 2006,
    "EmptyFootnote": 2007,
    "EmptyTableCell": 2008,
    "EmptyEndnote": 2009,
    "InvalidPolygon": 2010,
    "InvalidShapeSize": 2011,
    "EmptyEquation": 2012,
    "EmptyChart": 2013,
    "EmptyCategories": 2014,
    "SeriesLengthMismatch": 2015,
    "NonLeadingTableHeaderRow": 2016,
}
#: Limits of the readers.
LIMITS = {"file": 100 << 20, "inline": 50 << 20, "entry": 50 << 20, "total": 500 << 20, "entries": 10_000, "stream": 500 << 20, "ratio": 100, "sections": 256, "depth": 32, "series": 256, "points": 10_000, "columns": 10_000, "style": 100_000, "inheritance": 10}
#: Font and page of the named presets (A4, in hundredths of a point).
PRESETS = {"default": "함초롬돋움", "modern": "맑은 고딕", "classic": "바탕", "latest": "함초롬바탕"}
PAGES = {"A4": (59528, 84188), "Letter": (61200, 79200), "B5": (51591, 72850)}


def json_schema(frame: str) -> str:
    return FRAMES[frame].json()
