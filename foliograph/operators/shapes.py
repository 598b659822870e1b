"""Shapes, tables and their geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of page breaks and vertical alignments of tables.
PAGE_BREAKS = {0: "None", 1: "Table", 2: "Cell"}
VERTICAL = {0: "Top", 1: "Center", 2: "Bottom"}
#: Least extent of a line along each axis, and of a curve.
LINE_LEAST, CURVE_LEAST = 100, 1


def named(code: Column, names: dict[int, str]) -> Column:
    """Name of a code; unknown codes keep their number."""
    out = F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")"))
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def positive(x: Column) -> Column:
    """The value where it is above zero and fits 32 bits, else null."""
    return F.when((x > 0) & (x <= (1 << 31) - 1), x.cast("int"))


def box(points: DataFrame, keys: Sequence[str], x: str, y: str, least: int = CURVE_LEAST) -> DataFrame:
    """Bounding box of each shape's points, with the number of points; extents are ``least`` at least."""
    found = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.min(x).alias("left"), F.min(y).alias("top"), F.max(x).alias("__r"), F.max(y).alias("__b"))
    extent = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(least)).alias({"left": "width", "top": "height"}[a])
    return found.select(*keys, "points", "left", "top", extent("left", "__r"), extent("top", "__b"), (F.col("points") < 3).alias("too_few"))


def scale(value: Column, extent: Column, source: Column) -> Column:
    """A coordinate of the source box in the target's, in whole numbers toward zero; zero for an empty source."""
    return F.when(source == 0, F.lit(0).cast("long")).otherwise(F.try_divide(value.cast("long") * extent.cast("long"), source.cast("long")).cast("long"))


def row_headers(cells: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Rows that are headers because all their cells are, and those that mix."""
    return cells.groupBy(*keys).agg(F.bool_and(flag).alias("is_header"), (F.bool_or(flag) & ~F.bool_and(flag)).alias("mixed"))


def extents(cells: DataFrame, keys: Sequence[str], row: str, span: Column, declared: Column) -> DataFrame:
    """Rows of a table: what it declares or what its cells reach, whichever is more."""
    return cells.groupBy(*keys).agg(F.greatest(F.max(declared), F.max(F.col(row) + span)).alias("rows"))


def all_code(runs: DataFrame, keys: Sequence[str], font: str, fonts: Sequence[str]) -> DataFrame:
    """Paragraphs all of whose text runs have a code font."""
    code = F.lower(F.col(font)).rlike("|".join(fonts))
    return runs.groupBy(*keys).agg(F.bool_and(F.coalesce(code, F.lit(False))).alias("is_code"))


def merge_flags(cells: DataFrame, keys: Sequence[str], nested: DataFrame) -> DataFrame:
    """Tables with whether a cell spans others, and whether a cell holds a table; ``nested`` names the tables that do."""
    spans = cells.groupBy(*keys).agg(F.bool_or((F.col("col_span") > 1) | (F.col("row_span") > 1)).alias("has_merge"))
    inner = nested.select(*keys).distinct().withColumn("has_nested_table", F.lit(True))
    return spans.join(inner, list(keys), "left").fillna(False, ["has_nested_table"])


def image_extent(own: Column, hint: Column) -> Column:
    """Extent of an image: its own where it is positive, else the positive hint, else its own where it fits, else 0."""
    fits = F.when(own <= (1 << 31) - 1, own.cast("int"))
    return F.coalesce(positive(own), F.when(hint > 0, hint.cast("int")), fits, F.lit(0))


def image_placement(context: Column, x: Column, y: Column) -> Column:
    """How an image stands: inside a text box, in front of the text at its offsets, or as a character."""
    offsets = [F.greatest(F.least(v, F.lit(100_000_000)), F.lit(-100_000_000)) for v in (x, y)]
    placed = lambda wrap, flow, to, across, down: F.struct(F.lit(wrap).alias("wrap"), F.lit(flow).alias("flow_with_text"), F.lit(to).alias("relative_to"), across.cast("int").alias("x"), down.cast("int").alias("y"))
    return F.when(context == "TextBox", placed("Square", True, "Para", *offsets)).when((x != 0) | (y != 0), placed("InFrontOfText", False, "Paper", *offsets)).otherwise(placed("Inline", True, "Para", F.lit(0), F.lit(0)))


def classify(pictures: Column, objects: Column, rectangles: Column, lines: Column, polygons: Column, corners: Column) -> Column:
    """Kind of a drawing by its payloads: exactly one, and a polygon has three corners at least; otherwise unknown."""
    counts = [F.coalesce(c, F.lit(0)) for c in (pictures, objects, rectangles, lines, polygons)]
    kinds = ("Image", "OleObject", "Rect", "Line", "Polygon")
    out = F.lit("Unknown")
    for n, kind in zip(counts, kinds, strict=True):
        out = F.when((n > 0) & ((corners >= 3) if kind == "Polygon" else F.lit(True)), kind).otherwise(out)
    return F.when(sum(((n > 0).cast("int") for n in counts), F.lit(0)) == 1, out).otherwise("Unknown")


def line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A line as its box, start and end in the box; null where it has no length."""
    left, top = F.least(x1, x2), F.least(y1, y2)
    extent = lambda a, b: F.greatest(F.abs(b - a), F.lit(LINE_LEAST))
    made = F.struct(
        left.alias("left"), top.alias("top"), extent(x1, x2).alias("width"), extent(y1, y2).alias("height"),
        (x1 - left).alias("start_x"), (y1 - top).alias("start_y"), (x2 - left).alias("end_x"), (y2 - top).alias("end_y"),
    )
    return F.when((x1 != x2) | (y1 != y2), made)
