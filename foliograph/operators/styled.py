"""Style-aware Markdown of decoded documents: formats, headings, lists and code by style.

Every lookup is a join with the document's own style frames, and runs, blocks
and documents are put together by ordered aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text
from foliograph.functions.equation import latex
from foliograph.operators import order, render

_KEYS = ["doc_id", "section", "ordinal"]


def paragraph_texts(runs: DataFrame, char_shapes: DataFrame) -> DataFrame:
    """Text of each paragraph with its formats as markers; neighbouring runs of one format are one run."""
    shape = char_shapes.select(
        "doc_id", F.col("idx").alias("char_shape"), "bold", "italic", (F.col("strikeout") != "NONE").alias("strike"), F.lower("font").rlike("|".join(text.CODE_FONTS)).alias("code")
    )
    own = runs.filter("kind = 'text'").join(shape, ["doc_id", "char_shape"], "left").fillna(False, ["bold", "italic", "strike", "code"])
    merged = order.merge_runs(own, _KEYS, ["run"], ["bold", "italic", "strike", "code"], "text")
    plain = text.markdown("text")
    marked = F.when(F.col("code"), F.col("text")).otherwise(text.emphasise(plain, F.col("bold"), F.col("italic"), F.col("strike")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("island", marked.alias("t")))), lambda x: x["t"])
    return merged.groupBy(*_KEYS).agg(F.array_join(parts, "").alias("body"), F.bool_and("code").alias("is_code"))


def blocks(paragraphs: DataFrame, runs: DataFrame, char_shapes: DataFrame, para_shapes: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, section, ordinal, is_code, block) of the body's paragraphs.

    An outline level of the paragraph's shape makes a heading, before a list
    type, before what the style's name says.
    """
    body = paragraphs.filter("container = 'body'").join(paragraph_texts(runs, char_shapes), _KEYS, "left")
    shape = para_shapes.select("doc_id", F.col("idx").alias("para_shape"), F.col("heading").alias("list"), F.col("level").alias("shape_level"))
    named = styles.select("doc_id", F.col("idx").alias("style"), "name")
    found = body.join(shape, ["doc_id", "para_shape"], "left").join(named, ["doc_id", "style"], "left")
    by_name, shown = text.heading_level("name"), F.coalesce("body", F.lit(""))
    level = F.least(F.greatest(F.col("shape_level") + 1, F.lit(1)), F.lit(6))
    item = text.list_item(shown, F.col("list"), F.coalesce("shape_level", F.lit(0)), F.lit(None).cast("boolean"))
    block = (
        F.when(F.coalesce("is_code", F.lit(False)), shown)
        .when(F.col("list") == "OUTLINE", text.heading(shown, level))
        .when(F.col("list").isin("NUMBER", "BULLET"), item)
        .when(by_name.isNotNull(), text.heading(shown, by_name))
        .otherwise(F.concat(F.coalesce(text.list_prefix("name"), F.lit("")), shown))
    )
    return found.select(*_KEYS, F.coalesce("is_code", F.lit(False)).alias("is_code"), block.alias("block"))


def tables(frame: DataFrame, cells: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, section, ordinal, block) pipe tables in the place of their paragraph; nested tables are left to their cells."""
    at = runs.filter("kind = 'table'").select("doc_id", "section", "ordinal", F.concat(F.col("path"), F.lit(".runs["), F.col("run").cast("string"), F.lit("]")).alias("path"))
    placed = frame.filter(~F.col("path").contains(".table.")).join(at, ["doc_id", "section", "path"])
    drawn = render.pipe_table(render.rows_of(cells, ["doc_id", "table"], "row", "column", text.cell("text")), ["doc_id", "table"], "row", padded=True)
    return placed.join(drawn, ["doc_id", "table"]).select(*_KEYS, F.lit(False).alias("is_code"), F.col("markdown").alias("block"))


def markdown(frames: dict[str, DataFrame], marker: str = "<!-- foliograph:section -->") -> DataFrame:
    """(doc_id, markdown) of decoded packages; neighbouring code paragraphs are one fence."""
    own = blocks(*(frames[n] for n in ("paragraphs", "runs", "char_shapes", "para_shapes", "styles")))
    drawn = tables(frames["tables"], frames["cells"], frames["runs"])
    place = lambda df, half: df.withColumn("ordinal", F.col("ordinal") * 2 + half)  # noqa: E731  (a table follows its paragraph's text)
    all_blocks = place(own.filter("block <> ''"), 0).unionByName(place(drawn, 1))
    merged = order.merge_blocks(all_blocks, ["doc_id", "section"], ["ordinal"], F.col("is_code"), "block")
    return render.document(merged, "doc_id", "section", "first", "block", marker)


def footnotes(controls: DataFrame) -> DataFrame:
    """Notes numbered through the document, footnotes and endnotes apart."""
    notes = controls.filter(F.col("kind").isin("Footnote", "Endnote"))
    return notes.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("section", "control")))


def control_text(controls: DataFrame, paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, section, control, kind, shown): what each control leaves in style-aware Markdown.

    Notes leave a reference, which is numbered elsewhere, and have null here;
    equations are converted, too. Shapes without text, bookmarks and index marks
    leave nothing.
    """
    keys = ["doc_id", "section", "control"]
    texts = runs.filter("kind = 'text'").groupBy(*_KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r["text"]), "").alias("t"))
    owned = paragraphs.filter("owner IS NOT NULL").join(texts, _KEYS, "left").select("doc_id", "section", F.col("owner").alias("control"), "ordinal", F.coalesce("t", F.lit("")).alias("t"))
    inner = owned.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "t"))), lambda r: r["t"]), " ").alias("body"))
    found = controls.join(inner, keys, "left")
    kind, detail, hint = F.col("kind"), F.coalesce("detail", F.lit("")), F.coalesce("hint", F.lit(""))
    body = text.trim(F.coalesce("body", F.lit("")))
    safe = lambda c: F.replace(c, F.lit("--"), F.lit("\\-\\-"))
    memo = F.when(body == "", "").otherwise(F.concat(F.lit("<!-- memo(): "), safe(body), F.lit(" -->")))
    link = F.when(text.dangerous_url(detail), F.replace(hint, F.lit("]"), F.lit("\\]"))).otherwise(text.hyperlink(hint, detail))
    shown = (
        F.when(kind == "Hyperlink", link)
        .when(kind.isin("TextBox", "Ellipse", "Polygon"), body)
        .when(kind == "Equation", latex(detail))
        .when(kind == "Chart", "<!-- chart -->")
        .when(kind == "Dutmal", F.concat(detail, F.lit("("), hint, F.lit(")")))
        .when(kind == "Compose", detail)
        .when(kind == "CrossRef", F.concat(F.lit("["), detail, F.lit("]")))
        .when(kind == "Field", F.coalesce("hint", F.lit("____")))
        .when(kind == "Memo", memo)
        .when(kind.isin("Footnote", "Endnote"), F.lit(None).cast("string"))
        .when(kind.startswith("Unknown("), F.concat(F.lit("`["), F.regexp_extract(kind, r"\((.*)\)", 1), F.lit("]`")))
        .otherwise("")
    )
    return found.select(*keys, "kind", shown.alias("shown"))


def note_definitions(controls: DataFrame, paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, definitions): the texts of a document's notes, footnotes first, each behind the reference that stands for it.

    The texts of a note's paragraphs are joined by spaces and trimmed.
    """
    keys = ["doc_id", "section", "control"]
    texts = runs.filter("kind = 'text'").groupBy(*_KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r["text"]), "").alias("t"))
    owned = paragraphs.filter("owner IS NOT NULL").join(texts, _KEYS, "left").select("doc_id", "section", F.col("owner").alias("control"), "ordinal", F.coalesce("t", F.lit("")).alias("t"))
    inner = owned.groupBy(*keys).agg(text.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "t"))), lambda r: r["t"]), " ")).alias("body"))
    numbered = footnotes(controls).join(inner, keys, "left")
    mark = F.concat(F.when(F.col("kind") == "Footnote", "[^").otherwise("[^e"), F.col("number").cast("string"), F.lit("]: "), F.coalesce("body", F.lit("")))
    line = F.struct((F.col("kind") != "Footnote").alias("late"), "number", mark.alias("line"))
    return numbered.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("definitions"))


def image_map(runs: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, path, data): the images that runs show, each once, under the path that the Markdown names."""
    shown = runs.filter("kind = 'image'").select("doc_id", F.col("text").alias("key")).distinct()
    stem = F.regexp_replace("key", r"\.[^.]*$", "")
    stored = images.select("doc_id", stem.alias("stem"), F.col("key").alias("file"), "data")
    found = shown.join(stored, (shown["doc_id"] == stored["doc_id"]) & ((shown["key"] == stored["stem"]) | (shown["key"] == stored["file"])))
    return found.select(shown["doc_id"], F.concat(F.lit("images/"), "file").alias("path"), "data")
