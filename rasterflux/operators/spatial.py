"""Joins of boxes with boxes: many areas against many scenes, by cells of a hierarchy.

Level l divides the globe into squares of 360 / 2^l degrees. A box lives at the finest level whose squares are at least as large as it, so it meets at most four of them, and it is known to the squares
above as well. Two boxes that meet share a square at the coarser of their two levels, so one equality join in which the areas are at their own level, and one in which the scenes are, find
every pair; the corner where the overlap begins lies in one square only, which makes each pair once. Dates are joined by blocks of ``DAYS`` days in the same key, so a square that all
scenes share is split by time. No side is broadcast and nothing is compared outside of a shared square and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS, DAYS = 12, 32
_SIDES = [360.0 / (1 << k) for k in range(LEVELS)]


def _level(west: str, south: str, east: str, north: str) -> Column:
    """The finest level whose squares are as large as the box."""
    span = F.greatest(F.col(east) - F.col(west), F.col(north) - F.col(south))
    out = F.lit(0)
    for k in range(1, LEVELS):
        out = F.when(span <= _SIDES[k], k).otherwise(out)
    return out


def _cell(x: Column, side: Column) -> Column:
    return F.floor((x + 180) / side).cast("int")


def _in_cells(boxes: DataFrame, p: str, above: bool) -> DataFrame:
    """The boxes (columns ``p`` + west, ...) once for each square at their own level, or at the levels above it."""
    own = F.col(f"{p}level")
    level = F.explode(F.sequence(F.lit(0), own - 1) if above else F.array(own)).alias("level")
    rows = (boxes.where(f"{p}level > 0") if above else boxes).select("*", level)
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    cells = lambda a, b: F.sequence(_cell(F.col(p + a), side), _cell(F.col(p + b), side))
    rows = rows.select("*", F.explode(cells("west", "east")).alias("x"))
    return rows.select("*", F.explode(cells("south", "north")).alias("y"))


def _prepared(df: DataFrame, p: str) -> DataFrame:
    df = df.select(*[F.col(c).alias(p + c) for c in df.columns])
    sound = F.col(f"{p}west").isNotNull() & (F.col(f"{p}west") <= F.col(f"{p}east")) & (F.col(f"{p}south") <= F.col(f"{p}north"))
    return df.where(sound).withColumn(f"{p}level", _level(*[p + k for k in ("west", "south", "east", "north")]))


def _block(day: Column) -> Column:
    return F.floor(F.unix_date(day) / DAYS).cast("int")


def join(areas: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every pair of an area (west, south, east, north, start, end) and a scene (west, south, east, north, date) that meet, touching included, with the date within the area's, both inclusive.

    Columns are prefixed ``a_`` and ``s_``. Boxes that are null or out of order meet nothing; an area's open dates (null) meet nothing either.
    """
    a, s = _prepared(areas, "a_"), _prepared(scenes, "s_")
    a = a.where("a_start <= a_end").select("*", F.explode(F.sequence(_block(F.col("a_start")), _block(F.col("a_end")))).alias("block"))
    s = s.where("s_date is not null").withColumn("block", _block(F.col("s_date")))
    key = ["level", "x", "y", "block"]
    pairs = _in_cells(a, "a_", False).join(_in_cells(s, "s_", False).unionByName(_in_cells(s, "s_", True)), key)
    pairs = pairs.unionByName(_in_cells(a, "a_", True).join(_in_cells(s, "s_", False), key))
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    begins = lambda k: _cell(F.greatest(f"a_{k}", f"s_{k}"), side)
    meets = "a_west <= s_east and s_west <= a_east and a_south <= s_north and s_south <= a_north and s_date between a_start and a_end"
    return pairs.where(meets).where((begins("west") == F.col("x")) & (begins("south") == F.col("y"))).drop(*key, "a_level", "s_level")
