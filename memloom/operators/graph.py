"""Connected components of a graph too large for one machine, and numbering in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.plans.session import cut


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Of (u, v) rows: (u, least of u and its v). One row a node, combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut, drop: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: longs) but the roots; root is the least node.

    Alternating large-star and small-star steps: each moves neighbours to the least node
    in reach with two joins, until nothing changes; the number of rounds grows with the
    logarithm of the graph. No list of a node's neighbours is ever built. `keep` cuts the
    lineage of each round, `drop` frees what it kept.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = keep(edges)
    before = _sign(edges)
    while before[0]:
        # large star: neighbours above u go to the least node in reach of u
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        moved = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: what lies below u goes to the least of it, and so does u
        below = moved.distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least_neighbour(below)
        moved = below.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        after_edges = keep(moved.filter("a <> b").distinct())
        after = _sign(after_edges)
        if drop is not None:
            drop(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def numbered(rows: DataFrame, scope: str, order: list[str], name: str) -> DataFrame:
    """`rows` with the place of each in its scope, from 1, as a long.

    Rows are dealt by range, numbered within (range, scope), and each range starts after
    those before it: a scope spreads over as many tasks as it needs. Rows equal in order
    get places of their own, in no set order.
    """
    ranged = cut(rows.repartitionByRange(scope, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(scope, "_range").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as there are ranges and scopes
    before = F.sum("_n").over(Window.partitionBy(scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(scope).alias("_scope"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range", scope).orderBy(*order))
    out = ranged.withColumn("_here", here).join(starts, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_range") == F.col("_of")))
    return out.withColumn(name, F.col("_before") + F.col("_here")).drop("_range", "_here", "_scope", "_of", "_before")
