"""Lookups between document frames: styles, assets, owners, definitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.plans.staging import settled


def style_lookup(rows: DataFrame, styles: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row with its style's values; nulls where there is no such style. Spark picks the side to send."""
    return rows.join(styles.select(*on, *values), list(on), "left")


def missing(rows: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose target does not exist."""
    return rows.join(targets.select(*on), list(on), "left_anti")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last row of each key, by aggregation and so without sorting a hot key in one task."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])


def resolve_image(references: DataFrame, store: DataFrame, key: str, name: str) -> DataFrame:
    """Image key by full name, else by the name's stem; the first by key order wins."""
    stem = F.regexp_replace(F.regexp_replace(F.col(name), "^BinData/", ""), r"\.[^.]*$", "")
    exact = store.groupBy(F.col(name).alias("__name")).agg(F.min(key).alias("__exact"))
    stems = store.groupBy(stem.alias("__stem")).agg(F.min(key).alias("__by_stem"))
    found = references.join(exact, F.col("reference") == F.col("__name"), "left").join(stems, F.col("reference") == F.col("__stem"), "left")
    return found.withColumn("image_key", F.coalesce("__exact", "__by_stem")).drop("__name", "__exact", "__stem", "__by_stem")


def asset_join(objects: DataFrame, records: DataFrame, streams: DataFrame, on: str, name: str, extension: str) -> DataFrame:
    """Embedded objects with their record's first row and its stream, how sure the match is, and notes on it.

    The match is High with record and stream. Without a stream of the record's
    name it is Medium and says so, and Medium as well without a record.
    ``records`` have an ``ordinal``.
    """
    first = records.groupBy(on).agg(F.min_by(F.struct(name, extension), "ordinal").alias("__r"))
    stored = streams.select(F.col(name).alias("__stream")).distinct()
    joined = objects.join(first, on, "left").join(stored, F.col(f"__r.{name}") == F.col("__stream"), "left")
    record, stream = F.col("__r").isNotNull(), F.col("__stream").isNotNull()
    named = F.concat(F.lit("storage_name="), F.col(f"__r.{name}"), F.lit("; storage_extension="), F.col(f"__r.{extension}"))
    note = F.when(~record, "ole bin data record missing").when(stream, named).otherwise(F.concat(named, F.lit("; bin_data_stream_missing")))
    payload = F.when(stream, F.concat(F.lit("BinData/"), F.col("__stream")))
    return joined.select(*objects.columns, F.when(stream, "High").otherwise("Medium").alias("confidence"), payload.alias("package_path"), note.alias("notes"))


#: Extensions of the images that are taken over.
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "wmf", "emf")


def image_assets(records: DataFrame, streams: DataFrame, hints: DataFrame, on: str, name: str, extension: str, sizes: Sequence[str]) -> DataFrame:
    """Records of images whose stream is there, with the size hint of their id, and whether they are the last of their id."""
    own = records.filter(F.lower(extension).isin(*IMAGES)).join(streams.select(name).distinct(), name, "left_semi").join(hints.select(on, *sizes), on, "left")
    return own.withColumn("wins", F.col("ordinal") == F.max("ordinal").over(Window.partitionBy(on)))


def supplement(wanted: DataFrame, assets: DataFrame, on: str, value: str) -> DataFrame:
    """Every wanted id with its asset's value, or a warning that it has none."""
    found = wanted.select(on).distinct().join(assets.select(on, value), on, "left")
    missing_note = F.concat(F.lit("missing_image_asset_for_binary_data_id="), F.col(on).cast("string"))
    return found.withColumn("warning", F.when(F.col(value).isNull(), missing_note))


def owner_counts(children: DataFrame, owners: DataFrame, owner: str, kind: str) -> DataFrame:
    """Children by their owner's kind."""
    return children.join(owners.select(owner, kind), owner).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(owner).alias("owners"))


def resolve_definition(references: DataFrame, definitions: DataFrame, on: str, checkable: str, wants: Column) -> DataFrame:
    """References to definitions with what is wrong about them: out of range, or the wrong kind."""
    found = references.join(definitions.select(on, F.col(checkable).alias("__checkable")), on, "left")
    issue = (
        F.when(F.col("__checkable").isNull(), "index out of range")
        .when(wants & ~F.col("__checkable"), "checkable definition required")
        .when(~wants & F.col("__checkable"), "plain definition required")
    )
    return found.withColumn("issue", issue).drop("__checkable")


def compare_sides(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Both sides by key, also where one is missing, and whether all values agree."""
    a = left.select(*on, *[F.col(v).alias(f"{v}_source") for v in values])
    b = right.select(*on, *[F.col(v).alias(f"{v}_output") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_source").eqNullSafe(F.col(f"{v}_output"))
    return a.join(b, list(on), "full_outer").withColumn("status", F.when(same, "MATCH").otherwise("DIFF"))


def overlay(parent: DataFrame, child: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Definitions of both, the child's where both have one."""
    a, b = (side.select(F.col(key), *[F.col(v).alias(f"{v}{n}") for v in values], F.lit(True).alias(f"__in{n}")) for n, side in ((0, parent), (1, child)))
    joined = a.join(b, key, "full_outer")
    return joined.select(key, *[F.when(F.col("__in1"), F.col(f"{v}1")).otherwise(F.col(f"{v}0")).alias(v) for v in values])


def as_of(points: DataFrame, runs: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Value of the last run that starts at or before each point; null before the first.

    Both sides meet in one window by key, runs before points at the same place,
    so the cost is one sort by key and place and no pair is ever made.
    """
    both = points.select(*points.columns, F.lit(1).alias("__point"), F.lit(None).cast(runs.schema[value].dataType).alias("__value")).unionByName(
        runs.select(*keys, at, F.lit(0).alias("__point"), F.col(value).alias("__value")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(at, "__point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(w)).filter("__point = 1").drop("__point", "__value")


def ancestors(spark, edges: DataFrame, depth: int = 10) -> DataFrame:  # type: ignore[no-untyped-def]
    """(node, ancestor, distance, error) of parent edges (node, parent).

    A chain that returns to itself, leads to a parent that is no node, or is
    longer than ``depth`` ends in a row that names the error. Each level is one
    join of the frontier with the edges, whose rows are kept; a recursive query
    would hold them in memory and stop at a number of rows. All sides are merged:
    files of edges are far smaller than their rows, so no size that the planner
    knows would bound what it broadcasts.
    """
    own = settled(edges.select("node", "parent"))
    above = own.filter("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    error = F.when(F.col("parent") == F.col("node"), "circular")
    levels = [settled(own.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"), F.array("node").alias("seen"), error.alias("error")))]
    for distance in range(2, max(depth, 1) + 2):
        error = F.when(F.array_contains("seen", F.col("next")) | (F.col("next") == F.col("ancestor")), "circular").when(F.lit(distance > depth), "too deep")
        up = levels[-1].filter("error IS NULL").join(above.hint("merge"), "ancestor")
        level = settled(up.select("node", F.col("next").alias("ancestor"), F.lit(distance).alias("distance"), F.array_append("seen", F.col("ancestor")).alias("seen"), error.alias("error")))
        if level.isEmpty():
            break
        levels.append(level)
    found = reduce(DataFrame.unionAll, [level.drop("seen") for level in levels])
    known = own.select(F.col("node").alias("ancestor")).distinct().withColumn("known", F.lit(True))
    missing_parent = F.when(F.col("known").isNull(), "not found")
    return found.join(known.hint("merge"), "ancestor", "left").select("node", "ancestor", "distance", F.coalesce("error", missing_parent).alias("error"))


def with_known(rows: DataFrame, defined: DataFrame, key: str, builtin: int = 3) -> DataFrame:
    """Rows with whether their reference is built in (below ``builtin``) or defined."""
    there = defined.select(key).distinct().withColumn("__d", F.lit(True))
    return rows.join(there, key, "left").withColumn("known", (F.col(key) < builtin) | F.col("__d").isNotNull()).drop("__d")
