"""Styles: inheritance, partial merge, registries, presets, mappings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.operators.lookup import ancestors
from foliograph.schema import PRESETS


def inherit(spark, templates: DataFrame, name: str, parent: str, fields: Sequence[str], depth: int = 10, root_first: bool = False) -> DataFrame:  # type: ignore[no-untyped-def]
    """Each template with every field from itself or its nearest ancestor that sets it, and the error of its chain.

    A chain that is circular, too deep or leads nowhere resolves to nothing: its
    fields are null. ``root_first`` reproduces the older fold, in which the root
    wins over the templates between it and the leaf.
    """
    own = templates.select(F.col(name).alias("node"), F.col(parent).alias("parent"), *fields)
    chain = ancestors(spark, own.select("node", "parent"), depth)
    none = F.lit(None).cast("string").alias("error")
    reach = chain.unionByName(own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"), none))
    order = F.when(F.col("distance") == 0, F.lit(-1_000_000)).otherwise(F.col("distance") * (-1 if root_first else 1))
    joined = reach.join(own.select(F.col("node").alias("ancestor"), *fields).hint("merge"), "ancestor", "left").withColumn("__o", order)
    picks = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("__o"))).alias(f) for f in fields]
    resolved = joined.groupBy(F.col("node").alias(name)).agg(F.max("distance").alias("depth"), F.max("error").alias("error"), *picks)
    return resolved.select(name, "depth", "error", *[F.when(F.col("error").isNull(), F.col(f)).alias(f) for f in fields])


def with_base_font(fonts: DataFrame, face: str, old: str, preset: str) -> DataFrame:
    """Faces where the preset's font stands for the base font, and for no other."""
    return fonts.withColumn("new_face", F.when(F.col(face) == old, F.lit(PRESETS[preset])).otherwise(F.col(face)))


def merge_borders(child: DataFrame, parent: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Border fills of both: border and fill each whole from the child, else from the parent, else the default."""
    a = child.select(key, *[F.col(c).alias(f"{c}_c") for c in defaults])
    b = parent.select(key, *[F.col(c).alias(f"{c}_p") for c in defaults])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"{c}_c", f"{c}_p", F.lit(d)).alias(c) for c, d in defaults.items()])


def border_images(styles: DataFrame, keys: Sequence[str], image: str) -> DataFrame:
    """The images that each document's border fills ask for: distinct ids in order."""
    return styles.filter(F.col(image).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(image)).alias("images"))


def builtin_styles(spark, version: str = "modern") -> DataFrame:  # type: ignore[no-untyped-def]
    """Built-in styles of a version, a style's place as its id."""
    rows = [(version, i, *own) for i, own in enumerate(style_set(version))]
    return spark.createDataFrame(rows, "version string, id int, name string, english string, kind string, char_shape int, para_shape int")


def merge(child: dict[str, Column], parent: dict[str, Column], defaults: dict[str, object]) -> list[Column]:
    """Field by field the child's value, else the parent's, else the default."""
    return [F.coalesce(*[s[f] for s in (child, parent) if f in s], F.lit(defaults.get(f))).alias(f) for f in {**defaults, **parent, **child}]


def valid_name(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def restyle(fonts: DataFrame, face: str, order: str, preset: str) -> DataFrame:
    """The first font's face replaced wherever it occurs; others stay."""
    first = fonts.agg(F.min_by(face, order).alias("__first"))
    new = F.when(F.col(face) == F.col("__first"), F.lit(PRESETS[preset])).otherwise(F.col(face))
    return fonts.join(F.broadcast(first)).withColumn("new_face", new).drop("__first")  # one row on the broadcast side


def presets(spark) -> DataFrame:  # type: ignore[no-untyped-def]
    from foliograph.schema import PAGES

    return spark.createDataFrame([(n, f, *PAGES["A4"]) for n, f in PRESETS.items()], "name string, font string, width int, height int")


def map_heading(level: Column, styles: dict[int, str], body: str | None, first: str) -> Column:
    """Style of a heading level: its own, else that of the nearest smaller level, else body, else the first style."""
    out = F.lit(body if body is not None else first)
    for n in sorted(styles):
        out = F.when(level >= n, styles[n]).otherwise(out)
    return out


def frontmatter(c: Column) -> list[Column]:
    """has_frontmatter, title, author, created and body of a Markdown text.

    The block stands between a first line of three hyphens and the next line of
    three hyphens or dots; a mark of byte order may come before it.
    """
    text = F.regexp_replace(c, "^\ufeff", "")
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n(?:---|\.\.\.)\r?(?:\n|\z)", 1)
    found = text.rlike(r"(?s)\A---\r?\n.*?\r?\n(---|\.\.\.)\r?(\n|\z)")
    field = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1), "^[\"']|[\"']$", ""), F.lit(""))
    body = F.when(found, F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n(---|\.\.\.)\r?(\n|\z)", "")).otherwise(text)
    return [found.alias("has_frontmatter"), field("title").alias("title"), field("author").alias("author"), field("date").alias("created"), body.alias("body")]


def font_store(fonts: DataFrame, face: str, order: str) -> DataFrame:
    """Every font in every language, languages in the order they are written; ids count within a language."""
    from pyspark.sql import Window

    from foliograph.schema import LANGUAGES

    languages = F.posexplode(F.array(*map(F.lit, LANGUAGES))).alias("rank", "language")
    firsts = fonts.groupBy(face).agg(F.min(order).alias("first"))
    numbered = firsts.withColumn("idx", F.row_number().over(Window.orderBy("first")) - 1)  # one row for each font
    return numbered.select("idx", face, languages)


def registry_issues(styles: DataFrame, name: str, font: str, size: str, tab: str) -> DataFrame:
    """What is wrong with each style: name, font, size, tab definition."""
    issues = F.array(
        F.when(~valid_name(F.col(name)), "invalid name"),
        F.when(F.coalesce(F.col(font), F.lit("")) == "", "font required"),
        F.when(F.col(size).isNull(), "size required"),
        F.when(F.col(tab) < 3, "tab id reserved"),
    )
    return styles.select(name, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def outline_numbering(spark) -> DataFrame:  # type: ignore[no-untyped-def]
    """Ten outline levels with their formats."""
    #: Number formats and texts of the levels.
    levels = [("DIGIT", "^1."), ("HANGUL_SYLLABLE", "^2."), ("DIGIT", "^3)"), ("HANGUL_SYLLABLE", "^4)"), ("DIGIT", "(^5)"), ("HANGUL_SYLLABLE", "(^6)"), ("CIRCLED_DIGIT", "^7"), ("CIRCLED_HANGUL_SYLLABLE", "^8"), ("DIGIT", "^9"), ("DIGIT", "^10")]
    return spark.createDataFrame([(i + 1, f, t) for i, (f, t) in enumerate(levels)], "level int, format string, text string")


#: Built-in styles besides the outlines, as Korean name, English name, kind, character and paragraph shape.
_NAMED = (
    ("쪽 번호", "Page Number", "CHAR", 1, 0),
    ("머리말", "Header", "PARA", 2, 9),
    ("각주", "Footnote", "PARA", 3, 10),
    ("미주", "Endnote", "PARA", 3, 10),
    ("메모", "Memo", "PARA", 4, 11),
    ("차례 제목", "TOC Heading", "PARA", 5, 12),
    ("차례 1", "TOC 1", "PARA", 6, 13),
    ("차례 2", "TOC 2", "PARA", 6, 14),
    ("차례 3", "TOC 3", "PARA", 6, 15),
)
#: Paragraph shapes of the outlines that came later.
_LATE_OUTLINES = {8: 18, 9: 16, 10: 17}


def style_set(version: str = "modern") -> list[tuple[str, str, str, int, int]]:
    """Built-in styles of a version (classic, modern, latest); a style's place is its id."""
    outlines = [(f"개요 {n}", f"Outline {n}", "PARA", 0, _LATE_OUTLINES.get(n, n + 1)) for n in range(1, 8 if version == "classic" else 11)]
    late = [] if version == "classic" else [("캡션", "Caption", "PARA", 0, 19)]
    latest = [("줄 번호", "Line Number", "CHAR", 1, 0)] if version == "latest" else []
    return [("바탕글", "Normal", "PARA", 0, 0), ("본문", "Body", "PARA", 0, 1), *outlines, *_NAMED, *late, *latest]


def style_id(name: Column, version: str = "modern") -> Column:
    """Id of a built-in style by its Korean or English name, or null."""
    ids = {n: i for i, own in reversed(list(enumerate(style_set(version)))) for n in own[:2]}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]), name)


#: What a character shape has where neither a style nor its parents say otherwise; font and size have no default.
CHAR_DEFAULTS: dict[str, object] = {
    "bold": False, "italic": False, "color": 0, "underline_type": "None", "underline_color": None, "strikeout_shape": "None", "strikeout_color": None, "outline": "None", "shadow": "None", "emboss": False, "engrave": False,
    "vertical_position": "Normal", "shade_color": None, "emphasis": "None", "ratio": 100, "spacing": 0, "rel_sz": 100, "offset": 0, "use_kerning": False, "use_font_space": False, "char_border_fill_id": None,
}
#: The same for paragraph shapes.
PARA_DEFAULTS: dict[str, object] = {
    "alignment": "Left", "line_spacing_type": "Percentage", "line_spacing": 160.0, "space_before": 0, "space_after": 0, "indent_left": 0, "indent_right": 0, "indent_first_line": 0, "break_type": "None", "keep_with_next": False,
    "keep_lines_together": False, "widow_orphan": True, "tab_def_id": 0,
}


def resolve_styles(child: DataFrame, parent: DataFrame, key: str, defaults: dict[str, object], required: Sequence[str] = ()) -> DataFrame:
    """Styles of both, field by field from the child, else the parent, else the default, with the first required field that is missing.

    The frames may lack fields; a nested field has a column of its own, so it is
    merged by itself.
    """
    fields = [*required, *(f for f in defaults if f not in required)]
    a = child.select(key, *[F.col(f).alias(f"{f}_c") for f in fields if f in child.columns])
    b = parent.select(key, *[F.col(f).alias(f"{f}_p") for f in fields if f in parent.columns])
    both = a.join(b, key, "full_outer")
    value = lambda f: F.coalesce(*[F.col(f"{f}{s}") for s in ("_c", "_p") if f"{f}{s}" in both.columns], F.lit(defaults.get(f)))
    problem = F.coalesce(*[F.when(value(f).isNull(), f) for f in required], F.lit(None).cast("string"))
    return both.select(key, *[value(f).alias(f) for f in fields], problem.alias("missing"))


def registry_problems(templates: DataFrame, rows: DataFrame, tabs: DataFrame, lists: DataFrame, mappings: DataFrame) -> DataFrame:
    """(template, issue, subject) of everything that keeps templates from becoming a registry.

    ``rows`` are styles (template, name, font, size, tab), ``tabs`` definitions
    (template, id), ``lists`` numberings and bullets (template, kind, id), and
    ``mappings`` references (template, field, style).
    """
    key = "template"

    def issue(df: DataFrame, name: str, subject: Column) -> DataFrame:
        return df.select(key, F.lit(name).alias("issue"), subject.cast("string").alias("subject"))

    def repeated(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(key, *by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")

    wanted = rows.filter("tab >= 3").join(tabs.select(key, F.col("id").alias("tab")).distinct(), [key, "tab"], "left_anti")
    named = rows.select(key, F.col("name").alias("style")).distinct()
    parts = [
        issue(templates.select(key).join(rows.select(key).distinct(), key, "left_anti"), "EmptyStyleMap", F.lit(None)),
        issue(rows.filter(~valid_name(F.col("name"))), "InvalidStyleName", F.col("name")),
        issue(rows.filter("font IS NULL"), "FontRequired", F.col("name")),
        issue(rows.filter("size IS NULL"), "SizeRequired", F.col("name")),
        issue(wanted, "UnknownTabReference", F.col("name")),
        issue(tabs.filter("id < 3"), "ReservedTabDefinition", F.col("id")),
        issue(repeated(tabs.filter("id >= 3"), "id"), "DuplicateTabDefinition", F.col("id")),
        issue(repeated(lists, "kind", "id"), "DuplicateListDefinition", F.concat("kind", F.lit(" "), F.col("id").cast("string"))),
        issue(mappings.filter("style IS NOT NULL").join(named, [key, "style"], "left_anti"), "InvalidMappingReference", F.concat("field", F.lit(" "), "style")),
    ]
    return reduce(DataFrame.unionByName, parts)
