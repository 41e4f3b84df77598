"""Connected components of an undirected graph, and ranks over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflux.storage import discard, materialize


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node reachable) of every node with an edge, by alternating large and small stars.

    Each step is written to the shared folder, and the one before is deleted. Edges shrink to stars in about log(n) steps. A star's centre may be
    hot; its rows are pre-aggregated for the minimum and split by adaptive skew joins.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "stars")
    seen = None
    while (mark := e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != seen and mark[0]:
        seen = mark
        near = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        older, e = e, materialize(hung.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(older)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def numbered(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """The rows with ``number`` (from 1) in a total order, and running sums of columns up to each row (name -> column).

    Rows are dealt out by ranges of the order and written with the range's number, so a task sorts one range; the ranges' totals, one row each, give
    the offsets. Rows that are equal in the order must be interchangeable.
    """
    sums = sums or {}
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("_range", offset("_rows").alias("_first"), *[offset(f"_t_{k}").alias(f"_o_{k}") for k in sums])
    inside = W.partitionBy("_range").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "_range").withColumns(
        {"number": F.col("_first") + F.row_number().over(inside)} | {k: F.col(f"_o_{k}") + F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()}
    )
    out = out.drop("_range", "_first", *[f"_o_{k}" for k in sums])
    # What it reads can be discarded through it.
    out._scratch = dealt._scratch
    return out
