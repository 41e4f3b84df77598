"""Rings of regions by list ranking: the boundary's edges are rows, and no task ever holds a region's boundary.

Each unit edge knows the one that follows it. By pointer doubling every edge learns the least edge of its ring, which names the ring and starts it, and then how many steps it is away
from there: as many rounds as the longest ring's length has binary digits, each an equality join of the edges with themselves, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflux.operators.regions import boundary
from rasterflux.storage import discard, materialize


def followed(labelled: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, label, edge, r1, c1, r2, c2, next: the boundary edges, and for each the one that follows. Where a label's pixels meet at a corner only, the turn away from the inside keeps rings apart."""
    way = F.when(F.col("c2") > F.col("c1"), 0).when(F.col("r2") > F.col("r1"), 1).when(F.col("c2") < F.col("c1"), 2).otherwise(3)
    edges = boundary(labelled, keys).withColumn("way", way)
    edges = edges.withColumn("edge", (F.col("r1").cast("long") * (width + 1) + F.col("c1")) * 4 + F.col("way"))
    edges = materialize(edges, "ring-edges")
    after = edges.select(*keys, "label", F.col("r1").alias("r2"), F.col("c1").alias("c2"), F.col("edge").alias("next"), F.col("way").alias("next_way"))
    both = edges.join(after, [*keys, "label", "r2", "c2"])
    # The inside is on the right: of two ways on, the left one leaves it. A quarter to the left is three quarters to the right.
    turn = (F.col("next_way") - F.col("way") + 4) % 4
    best = F.max_by(F.struct("next", "next_way"), turn).alias("n")
    out = both.groupBy(*keys, "label", "edge", "way", "r1", "c1", "r2", "c2").agg(best)
    return out.select(*keys, "label", "edge", "way", "r1", "c1", "r2", "c2", F.col("n.next").alias("next"), F.col("n.next_way").alias("next_way"))


def _changed(df: DataFrame, column: str) -> tuple:
    return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("edge", column))).first()


def ranked(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges with ``ring`` (its least edge), ``position`` (from 0) and ``length``."""
    on = [*keys, "edge"]
    state = materialize(edges.select(*on, F.col("next").alias("to"), F.least("edge", "next").alias("ring")), "ring-names")
    seen = None
    while (mark := _changed(state, "ring")) != seen and mark[0]:
        seen = mark
        far = state.select(*keys, F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        older, state = state, materialize(state.join(far, [*keys, "to"]).select(*on, F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring")), "ring-names")
        discard(older)
    named = materialize(edges.join(state.select(*on, "ring"), on), "ring-named")
    discard(state)
    # Steps from an edge to the ring's start; an edge that has arrived stays.
    state = materialize(named.select(*on, "ring", F.col("next").alias("to"), F.lit(1).cast("long").alias("steps")), "ring-steps")
    while state.where("`to` != ring").take(1):
        far = state.select(*keys, F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        going = state.where("`to` != ring").join(far, [*keys, "to"]).select(*on, "ring", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"))
        older, state = state, materialize(state.where("`to` = ring").select(*on, "ring", "to", "steps").unionByName(going), "ring-steps")
        discard(older)
    length = named.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("length"))
    out = named.join(state.select(*on, "steps"), on).join(length, [*keys, "ring"])
    return out.withColumn("position", (F.col("length") - F.col("steps")) % F.col("length")).drop("steps")


def ring_corners(labelled: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, label, ring, outer, parent, position, r, c: the corners of every 4-connected label's rings, in order from the ring's least corner.

    ``outer`` rings run around their pixels, others around holes; ``parent`` is the outer ring of a hole's label, null for outer ones.
    """
    edges = materialize(ranked(followed(labelled, keys, width), keys), "ring-ranked")
    area = F.sum((F.col("c1") * F.col("r2") - F.col("c2") * F.col("r1")).cast("long"))
    rings = edges.groupBy(*keys, "label", "ring").agg((area > 0).alias("outer"))
    outer = rings.where("outer").groupBy(*keys, "label").agg(F.min("ring").alias("_parent"))
    corners = edges.where("way != next_way").select(*keys, "label", "ring", ((F.col("position") + 1) % F.col("length")).alias("position"), F.col("r2").alias("r"), F.col("c2").alias("c"))
    out = corners.join(rings, [*keys, "label", "ring"]).join(outer, [*keys, "label"])
    return out.select(*keys, "label", "ring", "outer", F.when(~F.col("outer"), F.col("_parent")).alias("parent"), "position", "r", "c")
