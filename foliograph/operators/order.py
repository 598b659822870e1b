"""Logic that runs along document order: sections, islands, numbering, offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _along(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _before(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return _along(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return _along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def split_sections(rows: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column) -> DataFrame:
    """Rows without the markers, with the section they stand in; markers at the start or side by side make no section."""
    flagged = rows.withColumn("__mark", marker.cast("int"))
    flagged = flagged.withColumn("__part", F.sum("__mark").over(_so_far(keys, order))).filter("__mark = 0")
    return flagged.withColumn("section", F.dense_rank().over(_along(keys, ["__part"])) - 1).drop("__mark", "__part")


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Number of the run of neighbouring rows with equal values, from 1."""
    w = _along(keys, order)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    start = (differs | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("__start", start).withColumn("island", F.sum("__start").over(_so_far(keys, order))).drop("__start")


def merge_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_code: Column, text: str) -> DataFrame:
    """Neighbouring code rows as one fenced block; every other row is a block of its own."""
    flagged = islands(rows.withColumn("is_code", is_code), keys, order, ["is_code"])
    alone = F.when(~F.col("is_code"), F.row_number().over(_along(keys, order)))
    flagged = flagged.withColumn("__own", alone)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    body = F.array_join(F.transform(parts, lambda x: x["__t"]), "\n")
    blocks = flagged.groupBy(*keys, "island", "__own", "is_code").agg(F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("rows"), body.alias("__body"))
    fenced = F.when(F.col("is_code"), F.concat(F.lit("```\n"), F.col("__body"), F.lit("\n```"))).otherwise(F.col("__body"))
    return blocks.select(*keys, "first", "rows", "is_code", fenced.alias("block"))


def continue_lists(rows: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, is_item: Column, is_rest: Column) -> DataFrame:
    """Whether a row continues the list item before it: a continuation of the same level, with nothing else between."""
    w = _before(keys, order)
    item = F.when(is_item, F.col(level)).when(~is_rest, F.lit(-1))
    return rows.withColumn("__item", item).withColumn("attaches", F.coalesce(is_rest & (F.last("__item", ignorenulls=True).over(w) == F.col(level)), F.lit(False))).drop("__item")


def numbering(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: int = 1) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(_along(keys, order)) + (start - 1))


def leading_headers(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_header: Column) -> DataFrame:
    """Header rows that come after a row that is none."""
    seen = F.max((~is_header).cast("int")).over(_before(keys, order))
    return rows.withColumn("misplaced", is_header & (F.coalesce(seen, F.lit(0)) == 1))


def offsets(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """Running sum of the sizes before each row."""
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(_before(keys, order)), F.lit(0)))


def preorder_ids(rows: DataFrame, keys: Sequence[str], path: Sequence[str]) -> DataFrame:
    """Ids from 0 in document order."""
    return rows.withColumn("node", F.row_number().over(_along(keys, path)) - 1)


def merge_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str], text: str) -> DataFrame:
    """Neighbouring runs of equal format as one run."""
    grouped = islands(rows, keys, order, same)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return grouped.groupBy(*keys, "island", *same).agg(F.count(F.lit(1)).alias("runs"), F.array_join(F.transform(parts, lambda x: x["__t"]), "").alias("text"))


def run_ends(runs: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """Style runs with the position at which the next one starts; null for the last."""
    return runs.withColumn("end", F.lead(start).over(_along(keys, [start])))


def intern(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with ids from 0 in the order of their first row.

    The ranking runs over one row for each value after the aggregation; it is
    meant for dictionaries such as the fonts of a registry.
    """
    firsts = rows.groupBy(value).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("uses"))
    return firsts.withColumn("id", F.row_number().over(Window.orderBy("first")) - 1)


def assign_by_count(parts: DataFrame, owners: DataFrame, keys: Sequence[str], index: str, owner: str, count: str) -> DataFrame:
    """Parts numbered from 0 dealt to owners in order, each taking as many as it counts.

    An owner's parts are a range of numbers; owner ranges are unrolled to one
    row for each number, so that the lookup is an equi-join.
    """
    first = F.coalesce(F.sum(count).over(_before(keys, [owner])), F.lit(0)).cast("long")
    ranges = owners.withColumn("__first", first).filter(F.col(count) > 0)
    each = ranges.select(*keys, owner, F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col(count) - 1)).alias("__n"))
    joined = parts.withColumn("__n", F.col(index).cast("long")).join(each, [*keys, "__n"], "left")
    return joined.drop("__n")


def split_runs(texts: DataFrame, runs: DataFrame, keys: Sequence[str], text: str, start: str, shape: str) -> DataFrame:
    """Pieces of each text between the starts of its style runs; text before the first run has shape 0."""
    at = F.struct(F.col(start).cast("long").alias(start), shape)
    starts = runs.select(*keys, at.alias("__at")).unionByName(texts.select(*keys, F.struct(F.lit(0).cast("long").alias(start), F.lit(0).cast(runs.schema[shape].dataType).alias(shape)).alias("__at")))
    starts = starts.groupBy(*keys, F.col(f"__at.{start}").alias("__s")).agg(F.max("__at").alias("__at"))
    every = starts.groupBy(*keys).agg(F.array_sort(F.collect_list("__at")).alias("__every"))
    # each text is joined once, with all its starts, and cut where it stands
    last = F.length(text) + 1
    end = lambda i: F.coalesce(F.try_element_at("__every", (i + 2).cast("int"))[start], last)
    piece = lambda r, i: F.struct(r[start].alias(start), r[shape].alias(shape), F.substring(F.col(text), (r[start] + 1).cast("int"), (end(i) - r[start]).cast("int")).alias("piece"))
    pieces = texts.join(every, list(keys)).select(*keys, F.explode(F.transform("__every", piece)).alias("__p"))
    return pieces.select(*keys, f"__p.{start}", f"__p.{shape}", "__p.piece").filter("piece <> ''")


def path_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a path inventory numbered by section, path, kind, reference and text; what is missing comes first."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in ("section", "path", "kind", "ref_id", "text")])
    return rows.withColumn("rank", F.row_number().over(w) - 1)


def by_place(rows: DataFrame, keys: Sequence[str], place: str, order: Sequence[str], number: str = "number") -> DataFrame:
    """Rows numbered through the body, then the headers, then the footers, each in its own order."""
    rank = F.array_position(F.array(*map(F.lit, ("body", "header", "footer"))), F.col(place))
    return rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(rank, *order)) - 1)
