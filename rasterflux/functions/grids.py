"""Grid and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E

MAX_DRONE_PIXELS = 25_000_000
HECTARE_M2 = 10_000.0


def common_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """The overlap of two flights (left, bottom, right, top, res; one row each) at the finer resolution; raises where there is none."""
    x, y = a.alias("a"), b.alias("b")
    low, high = lambda c: F.greatest(f"a.{c}", f"b.{c}"), lambda c: F.least(f"a.{c}", f"b.{c}")
    box = x.crossJoin(F.broadcast(y)).select(
        low("left").alias("left"), low("bottom").alias("bottom"), high("right").alias("right"), high("top").alias("top"), high("res").alias("res")
    )
    n = lambda lo, hi: F.expr(f"cast(({hi} - {lo}) / res as int)")
    out = box.withColumns({"width": n("left", "right"), "height": n("bottom", "top")})
    bad = F.when((F.col("left") >= F.col("right")) | (F.col("bottom") >= F.col("top")) | (F.col("width") < 1) | (F.col("height") < 1), F.raise_error(F.lit("the flights do not overlap"))).when(
        F.col("width").cast("long") * F.col("height") > MAX_DRONE_PIXELS, F.raise_error(F.lit("the overlap is too large"))
    )
    return out.withColumn("width", F.coalesce(bad.cast("int"), F.col("width")))


def chip_size(west: Column, south: Column, east: Column, north: Column, max_px: int) -> tuple[Column, Column]:
    """(width, height) of a chip with ``max_px`` on its longer side."""
    w, h = east - west, north - south
    scale = max_px / F.greatest(w, h)
    px = lambda side: F.greatest(F.lit(1), F.rint(side * scale).cast("int"))
    return px(w), px(h)


def ring_bounds(rings: Column) -> Column:
    """struct(west, south, east, north) of a polygon's outer ring."""
    xs, ys = F.transform(rings[0], lambda p: p[0]), F.transform(rings[0], lambda p: p[1])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def context_crop(bounds: Column, frame: Column, width: int, height: int, least: int = 224) -> Column:
    """struct(x0, y0, x1, y1): a centred pixel window of twice a region's size, at least ``least``, cut at the chip's edges and never empty."""
    fx = lambda lon: (lon - frame["west"]) / (frame["east"] - frame["west"]) * width
    fy = lambda lat: (frame["north"] - lat) / (frame["north"] - frame["south"]) * height
    x0, x1, y0, y1 = fx(bounds["west"]), fx(bounds["east"]), fy(bounds["north"]), fy(bounds["south"])
    half = F.greatest(2 * (x1 - x0), 2 * (y1 - y0), F.lit(float(least))) / 2

    def cut(a: Column, b: Column, n: int) -> tuple[Column, Column]:
        middle = (a + b) / 2
        start = F.floor(F.greatest(F.lit(0.0), F.least(middle - half, F.lit(n - 1.0)))).cast("int")
        return start, F.floor(F.least(F.lit(float(n)), F.greatest(start + 1.0, middle + half))).cast("int")

    (a, b), (c, d) = cut(x0, x1, width), cut(y0, y1, height)
    return F.struct(a.alias("x0"), c.alias("y0"), b.alias("x1"), d.alias("y1"))


def crop_box(bounds: Column) -> Column:
    """A square around a region, in degrees."""
    w, h = bounds["east"] - bounds["west"], bounds["north"] - bounds["south"]
    half = F.greatest(F.lit(0.0101), 0.8 * w, 0.8 * h)
    x, y = (bounds["east"] + bounds["west"]) / 2, (bounds["north"] + bounds["south"]) / 2
    return F.struct((x - half).alias("west"), (y - half).alias("south"), (x + half).alias("east"), (y + half).alias("north"))


def size_label(bounds: Column) -> Column:
    """Width by height in km, 111 km a degree."""
    side = lambda a, b: F.format_string("%.1f", (bounds[b] - bounds[a]) * 111)
    return F.concat(side("west", "east"), F.lit(" x "), side("south", "north"), F.lit(" km"))


def target_grid(boxes: DataFrame, key: str, res: float = 10.0, most: int = 9_000_000) -> DataFrame:
    """Per box (key, west, south, east, north; degrees): its zone, the projected bounds snapped outward to the resolution, and width and height; raises when read where the box is out of order or too large.

    The box's edges are projected at 22 points each, as straight edges bend in the projection.
    """
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    zoned = boxes.withColumn("epsg", E.utm_epsg(middle("west", "east"), middle("south", "north")))
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(21)), lambda k: k / 21.0))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("t")
    pts = F.array(
        F.struct(at("west", "east").alias("lon"), F.col("south").alias("lat")), F.struct(at("west", "east").alias("lon"), F.col("north").alias("lat")),
        F.struct(F.col("west").alias("lon"), at("south", "north").alias("lat")), F.struct(F.col("east").alias("lon"), at("south", "north").alias("lat")),
    )
    order = (F.col("west") < F.col("east")) & (F.col("south") < F.col("north"))
    points = zoned.select(key, "epsg", order.alias("order"), "west", "south", "east", "north", t.alias("t")).select(key, "epsg", "order", F.inline(pts))
    x, y = E.utm_forward("lon", "lat", "epsg")
    points = points.select(key, "epsg", "order", x.alias("x"), y.alias("y"))
    low, high = lambda c: F.floor(F.min(c) / res) * res, lambda c: F.ceil(F.max(c) / res) * res
    out = points.groupBy(key, "epsg").agg(low("x").alias("left"), low("y").alias("bottom"), high("x").alias("right"), high("y").alias("top"), F.bool_and("order").alias("order"))
    n = lambda a, b: F.greatest(F.rint((F.col(b) - F.col(a)) / res).cast("long"), F.lit(1))
    out = out.withColumns({"width": n("left", "right"), "height": n("bottom", "top")})
    bad = F.when(~F.col("order"), F.raise_error(F.lit("the box is out of order"))).when(F.col("width") * F.col("height") > most, F.raise_error(F.lit("the box has too many pixels")))
    return out.withColumn("width", F.coalesce(bad.cast("long"), F.col("width"))).drop("order")


def roll(plane: DataFrame, dy: int, dx: int, height: int, width: int, most: int = 32) -> DataFrame:
    """A circular shift, or none beyond ``most`` pixels."""
    if max(abs(dy), abs(dx)) > most:
        return plane
    return plane.withColumns({"r": F.pmod(F.col("r") + dy, F.lit(height)), "c": F.pmod(F.col("c") + dx, F.lit(width))})
