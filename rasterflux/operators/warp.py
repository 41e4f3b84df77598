"""Warping: values of a raster at the pixel centres of another grid, whatever its place, rotation or projection.

The caller gives, for every target pixel, where its centre lies in the source in rows and columns. Target pixels go to the source block that holds the first of their four
neighbours, and a source pixel goes to its block and, on the border, to the blocks before it, so every block finds all its neighbours: one exchange of either side, and no
join of pixels. A block has ``BLOCK`` x ``BLOCK`` source pixels. Where many target pixels fall into one block (a much finer target), they are dealt to parts of at most ``MOST`` pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E
from rasterflux.operators.change import PIXEL

BLOCK, MOST = 256, 1 << 20


def affine(a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """(row, column) in the source of a target pixel's centre: row = a + b (r + .5) + c (c + .5), column = d + e (r + .5) + f (c + .5), where a source pixel's centre is at whole numbers."""
    r, col = F.col("r") + 0.5, F.col("c") + 0.5
    return a + b * r + c * col, d + e * r + f * col


def degrees_to_utm(origin: tuple[float, float], step: tuple[float, float], source_origin: tuple[float, float], pixel: float, epsg: int) -> tuple[Column, Column]:
    """(row, column) in a UTM source of the pixels of a grid in degrees. Origins are the (west, north) corners, ``step`` the degrees of a target pixel, ``pixel`` the metres of a source pixel."""
    lon, lat = origin[0] + (F.col("c") + 0.5) * step[0], origin[1] - (F.col("r") + 0.5) * step[1]
    x, y = E.utm_forward(lon, lat, F.lit(epsg))
    return (source_origin[1] - y) / pixel - 0.5, (x - source_origin[0]) / pixel - 0.5


def _bilinear(rows: np.ndarray, cols: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Means of the four neighbours that have a value, by their weights."""
    i, j = np.floor(rows).astype(int), np.floor(cols).astype(int)
    fy, fx = rows - i, cols - j
    total, weight = np.zeros(len(rows)), np.zeros(len(rows))
    for di in (0, 1):
        for dj in (0, 1):
            w = (fy if di else 1 - fy) * (fx if dj else 1 - fx)
            v = plane[np.minimum(i + di, plane.shape[0] - 1), np.minimum(j + dj, plane.shape[1] - 1)]
            used = (w > 0) & ~np.isnan(v)
            total[used] += (w * v)[used]
            weight[used] += w[used]
    with np.errstate(invalid="ignore"):
        return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def _block_values(target: pa.Table, source: pa.Table, value: str, nearest: bool, kind: pa.DataType) -> pa.Table:
    if not target.num_rows or not source.num_rows:
        return pa.table({"r": pa.array([], pa.int32()), "c": pa.array([], pa.int32()), value: pa.array([], kind)})
    col = lambda t, k: t.column(k).to_numpy()
    top, left = int(target.column("by")[0].as_py()) * BLOCK, int(target.column("bx")[0].as_py()) * BLOCK
    plane = np.full((BLOCK + 1, BLOCK + 1), np.nan)
    plane[col(source, "r") - top, col(source, "c") - left] = source.column("v").cast(pa.float64()).to_numpy()
    y, x = col(target, "y") - top, col(target, "x") - left
    if nearest:
        found = plane[np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int)]
    else:
        found = _bilinear(y, x, plane)
    seen = ~np.isnan(found)
    return pa.table({"r": pa.array(col(target, "r")[seen]), "c": pa.array(col(target, "c")[seen]), value: pa.array(found[seen]).cast(kind)})


def warp(source: DataFrame, target: DataFrame, value: str, place: tuple[Column, Column], nearest: bool = False, parts: int = 1) -> DataFrame:
    """r, c, value of the target pixels that have a source pixel near enough: bilinear over the neighbours that have a value, or the nearest pixel (for classes, which must not be blended).

    ``source`` and ``target`` are keyed by (r, c), ``place`` gives (row, column) in the source. ``parts`` deals each block's target pixels to as many groups; see ``parts_for``.
    """
    kind = {"int": pa.int32(), "bigint": pa.int64()}.get(dict(source.dtypes)[value], pa.float64())
    y, x = place
    # The block of the first neighbour; for the nearest pixel, that of the place, rounded down all the same.
    t = target.select(*[F.col(k).cast("int").alias(k) for k in PIXEL]).select("r", "c", y.cast("double").alias("y"), x.cast("double").alias("x"))
    t = t.where("y is not null and x is not null and not isnan(y) and not isnan(x)").withColumns(
        {"by": F.floor(F.floor("y") / BLOCK).cast("int"), "bx": F.floor(F.floor("x") / BLOCK).cast("int"), "part": F.pmod(F.xxhash64("r", "c"), F.lit(parts)).cast("int")}
    )
    v = E.absent(F.col(value).cast("double"))
    s = source.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), v.alias("v")).where("v is not null")
    around = lambda k: F.when(F.col(k) % BLOCK == 0, F.array(F.floor(F.col(k) / BLOCK).cast("int"), (F.floor(F.col(k) / BLOCK) - 1).cast("int"))).otherwise(F.array(F.floor(F.col(k) / BLOCK).cast("int")))
    s = s.select("*", F.explode(around("r")).alias("by")).select("*", F.explode(around("c")).alias("bx"))
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_values(left, right, value, nearest, kind)

    names = {pa.int32(): "int", pa.int64(): "bigint"}
    return t.groupBy("by", "bx", "part").cogroup(s.groupBy("by", "bx", "part")).applyInArrow(block, f"r int, c int, {value} {names.get(kind, 'double')}")


def parts_for(finer: float) -> int:
    """Parts that keep a group of target pixels below ``MOST``, where a source pixel's side has ``finer`` target pixels."""
    return max(1, int(-(-((BLOCK * finer) ** 2) // MOST)))
