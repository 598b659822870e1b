"""Whole jobs over folders of files, as the command line offers them: each reads with Spark and returns a frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import deep, lookup, styled, styles, validate
from foliograph.operators.styles import frontmatter
from foliograph.plans.staging import settled
from foliograph.schema import PRESETS
from foliograph.sources import compound, exchange, markdown, packages, patching


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    """Packages of a folder, each opened and parsed once however many frames are read."""
    return settled(packages.read(spark, path))


def _frames(nested: DataFrame) -> dict[str, DataFrame]:
    return {n: packages.frame(nested, n) for n in packages.PARTS}


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Counts of each section of each package, shallow and deep."""
    return deep.summary(_frames(_decoded(spark, path)))


def to_md(spark: SparkSession, path: str) -> DataFrame:
    """Style-aware Markdown of each package."""
    return styled.markdown(_frames(_decoded(spark, path)))


def to_json(spark: SparkSession, path: str, section: int | None = None) -> DataFrame:
    f = _frames(_decoded(spark, path))
    return exchange.to_json(exchange.documents(f["paragraphs"], f["runs"]), section)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Packages of exported documents, one JSON document in each file."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("json"))
    docs = exchange.from_json(texts).filter("error IS NULL")
    runs = exchange.flat_runs(docs).filter("kind = 'text'")
    parts = F.array_sort(F.collect_list(F.struct("run", "text")))
    own = runs.groupBy("doc_id", "section", "ordinal").agg(F.array_join(F.transform(parts, lambda r: r["text"]), "").alias("text"))
    return packages.encode(own)


def check(spark: SparkSession, path: str) -> DataFrame:
    """Validity and first issue of each package."""
    nested = _decoded(spark, path)
    return validate.validate(nested.select("doc_id"), _frames(nested))


def convert(spark: SparkSession, path: str, preset: str | None = None) -> DataFrame:
    """Packages of Markdown files; front matter is taken off, and the preset's font stands for the base font."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("md"))
    body = texts.select("doc_id", *frontmatter(F.col("md"))).select("doc_id", "body")
    blocks = markdown.decode(body, "doc_id", "body")
    cell = lambda r: lambda t, c: F.struct(
        r.cast("int").alias("row"), c.cast("int").alias("column"), F.lit(1).alias("col_span"), F.lit(1).alias("row_span"), F.lit(False).alias("is_header"), F.lit(0).alias("width"), F.lit(0).alias("height"), t.alias("text")
    )
    cells = F.flatten(F.transform("rows", lambda r, i: F.transform(r, cell(i))))
    style = F.when(F.col("kind") == "heading", F.col("level") + 1).otherwise(0)
    return packages.encode(blocks.select("doc_id", "section", "ordinal", "text", style.cast("int").alias("style"), cells.alias("cells")), font=PRESETS[preset] if preset else packages.BASE_FONT)


def convert_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Packages of legacy files."""
    return compound.convert(compound.read(spark, path))


def census(spark: SparkSession, path: str) -> DataFrame:
    """Records by tag of each legacy file."""
    return compound.tag_census(compound.frame(compound.read(spark, path), "records"))


def totals(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """One summary row of each document."""
    return paragraphs.groupBy("doc_id").agg(F.countDistinct("section").alias("sections"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("characters"))


def audit(spark: SparkSession, source: str, output: str) -> DataFrame:
    """Legacy files beside the packages made of them, metric by metric; documents meet by file name without extension."""
    stem = F.regexp_extract("doc_id", r"([^/]+?)(?:\.[^./]*)?$", 1)
    own = compound.frame(compound.read(spark, source), "paragraphs").withColumn("doc_id", stem)
    runs = packages.frame(packages.read(spark, output), "runs").filter("kind = 'text'").withColumn("doc_id", stem)
    parts = F.array_sort(F.collect_list(F.struct("run", "text")))
    made = runs.groupBy("doc_id", "section", "ordinal").agg(F.array_join(F.transform(parts, lambda r: r["text"]), "").alias("text"))
    return lookup.compare_sides(totals(own.filter("text <> ''")), totals(made), ["doc_id"], ["sections", "paragraphs", "characters"])


def summary(audited: DataFrame) -> DataFrame:
    """Documents by verdict."""
    return audited.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def templates(spark: SparkSession) -> DataFrame:
    return styles.presets(spark)


def restyle(spark: SparkSession, path: str, preset: str) -> DataFrame:
    """Packages whose first font has the preset's face wherever it occurs; everything else stays as it is."""
    return patching.restyle(spark.read.format("binaryFile").load(path), PRESETS[preset])


def patch(spark: SparkSession, path: str, changes: str) -> DataFrame:
    """Packages with the text changes of a JSON-lines folder (doc_id, section, sha256, path, text)."""
    rows = spark.read.schema("doc_id string, section int, sha256 string, path string, text string").json(changes)
    return patching.apply(spark.read.format("binaryFile").load(path), rows)


def issues(spark: SparkSession, path: str) -> DataFrame:
    """Every issue and reader warning of each package."""
    nested = _decoded(spark, path)
    frames = _frames(nested)
    found = validate.issues(nested.select("doc_id"), frames).select("doc_id", "code", F.col("rule").alias("detail"))
    return reduce(DataFrame.unionByName, [found, frames["warnings"]])


