"""Connected components of an edge table, entirely on the executors.

Alternating star contraction: every round turns each vertex's neighbourhood
into a star around its smallest member, first over the larger neighbours and
then over the smaller ones, and the number of rounds grows with the logarithm
of the longest chain. Both half-steps are an aggregation (with map-side
combine, so a vertex with a million neighbours arrives as one row per task)
followed by a join that Spark may split when one vertex is hot. Each round is
cut from its lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) rows, u > v: every larger neighbour of u moves to u's smallest."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(u, v) rows, u > v: every smaller neighbour of u, and u, move to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every vertex that has an edge; root is the smallest reachable.

    Vertices may be of any orderable type. Nulls and self-loops are ignored,
    repeated edges count once, and an empty edge table gives an empty result.
    """
    state = cut(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    last = None
    while True:
        # the multiset of edges is unchanged exactly when every component is a star
        state = cut(_small_star(_large_star(state)))
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.unionByName(roots)
