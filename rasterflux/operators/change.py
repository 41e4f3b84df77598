"""Pixel operators: baseline differences, fusion into tiers, coverage, series persistence, focal mean, stretch, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E
from rasterflux.shipping import ship

PIXEL = ("r", "c")


def ordinals(px: DataFrame, step: str = "step") -> DataFrame:
    """step, ordinal (from 0) of the dates that a sensor has: a window without a usable scene has no rows and no ordinal. At most ``steps`` rows."""
    return px.select(step).distinct().withColumn("ordinal", F.row_number().over(W.orderBy(step)) - 1)


def baseline_diff(px: DataFrame, values: str | dict[str, str], valid: str, step: str = "step", dates: list[int] | None = None) -> DataFrame:
    """r, c, step, t, differences and valid of each later date against the sensor's first usable date, by one window instead of a self-join.

    ``t`` counts the sensor's later dates from 0, whatever windows between have no scene. ``dates`` are the steps that it has, in order, where they are known; else
    they are read from the pixels first.
    """
    values = {"diff": values} if isinstance(values, str) else values
    if dates is None:
        px = px.join(F.broadcast(ordinals(px, step)), step)
    else:
        px = px.withColumn("ordinal", F.array_position(F.lit(dates), F.col(step)).cast("int") - 1)
    first = F.struct(*[E.absent(v).alias(k) for k, v in values.items()], F.col(valid).alias("ok"))
    df = px.withColumn("_b", F.max(F.when(F.col("ordinal") == 0, first)).over(W.partitionBy(*PIXEL)))
    diffs = [(E.absent(v) - F.col(f"_b.{k}")).alias(k) for k, v in values.items()]
    kept = df.where((F.col("ordinal") > 0) & F.col("_b").isNotNull())
    return kept.select(*PIXEL, step, (F.col("ordinal") - 1).alias("t"), *diffs, (F.col(valid) & F.col("_b.ok")).alias("valid"))


def pair_diff(px: DataFrame, values: dict[str, Column], valid: Column, before: int, after: int, never: Column | None = None) -> DataFrame:
    """One row per pixel seen on both dates: differences of several values and the joint validity, in one aggregation.

    ``never``: where either date did not image the pixel at all.
    """
    at = lambda x, s: F.max(F.when(F.col("step") == s, x))
    ok = at(valid.cast("int"), before) * at(valid.cast("int"), after)
    extra = [] if never is None else [F.bool_or(never).alias("never")]
    return (
        px.where(F.col("step").isin(before, after))
        .groupBy(*PIXEL)
        .agg(*[(at(E.absent(v), after) - at(E.absent(v), before)).alias(k) for k, v in values.items()], ok.alias("_ok"), *extra)
        .where("_ok is not null")
        .withColumn("valid", F.col("_ok") == 1)
        .drop("_ok")
    )


def fuse(grid: DataFrame, optical: DataFrame, radar: DataFrame) -> DataFrame:
    """The dense grid with d2, v2, d1, v1, tier and direction; a sensor that has no row did not observe."""
    o = optical.select(*PIXEL, F.col("diff").alias("d2"), F.col("valid").alias("v2"), *[c for c in optical.columns if c not in (*PIXEL, "diff", "valid")])
    s = radar.select(*PIXEL, F.col("diff").alias("d1"), F.col("valid").alias("v1"))
    df = grid.join(o, list(PIXEL), "left").join(s, list(PIXEL), "left")
    df = df.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("v2", "v1")})
    df = df.withColumn("tier", E.tier("d2", "v2", "d1", "v1"))
    return df.withColumn("direction", E.tier_direction("tier", "d2", "d1"))


def coverage(fused: DataFrame, never: Column | None = None) -> DataFrame:
    """Percentages of all grid pixels, in one pass."""
    share = lambda cond: F.round(F.avg(cond.cast("double")) * 100, 1)
    gap = ~F.col("v2") & F.col("v1")
    never = F.lit(False) if never is None else never
    return fused.agg(
        share(F.col("v2")).alias("s2_usable"),
        share(F.col("v1")).alias("s1_usable"),
        share(gap).alias("optical_gap"),
        share(gap & never).alias("never_imaged"),
        share(gap & ~never).alias("cloud_gap"),
        share(~F.col("v2") & ~F.col("v1")).alias("not_observed"),
    )


def coverage_warnings(stats: DataFrame) -> DataFrame:
    texts = [
        F.when(F.col("not_observed") > 10, F.format_string("%.1f%% of the area was not observed by any sensor", "not_observed")),
        F.when(
            (F.col("optical_gap") > 20) & (F.col("never_imaged") >= 1),
            F.format_string("optical gap %.1f%%: %.1f%% cloud, %.1f%% outside the footprint", "optical_gap", "cloud_gap", "never_imaged"),
        ).when(F.col("optical_gap") > 20, F.format_string("optical gap %.1f%%", "optical_gap")),
    ]
    return stats.withColumn("warnings", F.array_compact(F.array(*texts)))


def tier_hectares(fused: DataFrame, pixel_area_m2: float = 100.0) -> DataFrame:
    """All four tiers, 0 where none."""
    spark = fused.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in E.TIERS])).alias("tier"))
    counts = fused.where("tier is not null").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return names.join(F.broadcast(counts), "tier", "left").select("tier", n.alias("pixels"), F.round(E.hectares(n, pixel_area_m2), 2).alias("hectares"))


def windows(span: DataFrame, start: str, end: str, steps: str) -> DataFrame:
    """Contiguous windows of [start, end); the last day is excluded. Edges are rounded half to even."""
    i, n, days = F.col("i"), F.col(steps), F.date_diff(F.col(end), F.col(start))
    edge = lambda k: F.date_add(F.col(start), F.rint(days * k / n).cast("int"))
    return span.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(
        i.alias("window"), edge(i).alias("window_start"), F.date_sub(edge(i + 1), 1).alias("window_end")
    )


def persistence(diffs: DataFrame, threshold: float, min_persist: int = 1, order: str = "t", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per pixel from (r, c, t, diff, valid): persistent, latest, transient, change_index, confirmations, signed, and the columns ``carry`` as they are at the change (null where there is none).

    A crossing is confirmed by all later valid dates agreeing in sign; two windows over the pixel's own dates replace a self-join.
    """
    d, ok = F.coalesce(E.absent("diff"), F.lit(0.0)), F.coalesce("valid", F.lit(False))
    crossed = E.crossing("diff", "valid", threshold)
    later = W.partitionBy(*PIXEL).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    count = lambda cond: F.coalesce(F.sum(cond.cast("int")).over(later), F.lit(0))
    df = diffs.withColumns({"_x": crossed, "_nv": count(ok), "_np": count(crossed & (d > 0)), "_nn": count(crossed & (d < 0))})
    agree = F.when(d > 0, F.col("_np")).otherwise(F.col("_nn"))
    df = df.withColumn("_conf", F.col("_x") & (F.col("_nv") >= min_persist) & (agree == F.col("_nv")))
    df = df.withColumn("_late", F.col("_x") & (F.col("_nv") == 0)).withColumn("_agree", agree)
    first = F.min(F.when(F.col("_conf") | F.col("_late"), F.struct(F.col(order).alias("t"), d.alias("d"), F.col("_agree").alias("n"), F.col("_conf").alias("conf"), F.col("_late").alias("late"), *[F.col(k).alias(f"_{k}") for k in carry])))
    out = df.groupBy(*PIXEL).agg(first.alias("f"), F.bool_or("_x").alias("ever"), F.bool_or(ok).alias("observed"))
    # Changed is persistent or latest; transient pixels, and only they, crossed without it.
    return out.select(
        *PIXEL,
        F.col("f").isNotNull().alias("changed"),
        F.coalesce("f.conf", F.lit(False)).alias("persistent"),
        F.coalesce("f.late", F.lit(False)).alias("latest"),
        (F.col("ever") & F.col("f").isNull()).alias("transient"),
        F.coalesce("f.t", F.lit(-1)).cast("int").alias("change_index"),
        F.coalesce("f.n", F.lit(0)).cast("int").alias("confirmations"),
        F.coalesce("f.d", F.lit(0.0)).alias("signed"),
        "observed",
        *[F.col(f"f._{k}").alias(k) for k in carry],
    )


def plane_at(stack: DataFrame, change: DataFrame, value: str, last: int) -> DataFrame:
    """The value at each pixel's change index (clipped to the stack), 0 where there is none."""
    at = change.select(*PIXEL, "change_index", F.least("change_index", F.lit(last)).alias("t"))
    return at.join(stack.select(*PIXEL, "t", value), [*PIXEL, "t"], "left").select(
        *PIXEL, "change_index", F.when(F.col("change_index") >= 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias(value)
    )


def boxcar(dense: DataFrame, value: str, size: int, height: int, width: int) -> DataFrame:
    """NaN-ignoring mean over size x size pixels with the nearest edge repeated, as two moving frames over a dense grid.

    NULL is absent. Holes with any valid neighbour are filled.
    """
    if size <= 1:
        return dense
    lo, hi = (size // 2, size - 1 - size // 2) if size % 2 == 0 else (size // 2, size // 2)

    def pass_(df: DataFrame, part: str, order: str, n: int, names: list[str]) -> DataFrame:
        w = W.partitionBy(part).orderBy(order)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        below, above = F.greatest(F.lit(lo) - F.col(order), F.lit(0)), F.greatest(F.col(order) + hi - (n - 1), F.lit(0))
        moved = {
            k: F.sum(k).over(w.rowsBetween(-lo, hi)) + below * F.first(k).over(whole) + above * F.last(k).over(whole) for k in names
        }
        return df.withColumns(moved)

    v = F.col(value)
    df = dense.withColumns({"_s": F.coalesce(v, F.lit(0.0)), "_n": v.isNotNull().cast("double")})
    df = pass_(pass_(df, "r", "c", width, ["_s", "_n"]), "c", "r", height, ["_s", "_n"])
    return df.withColumn(value, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))).drop("_s", "_n")


#: Buckets of a column's interval in one pass.
DIGITS = 4096


def exact_percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """The exact values of several columns at the shares, interpolated linearly; absent values do not count, and a column without values gives None.

    The first pass counts and bounds all columns. Each further one divides the interval of every rank that is not settled yet into ``DIGITS`` buckets, all in one scan that adds up counts and
    bounds per bucket in the tasks; the rank's bucket is its next interval, until it holds one value. What reaches the driver are buckets, at most ``DIGITS`` a rank, never values.
    """
    v = df.select(*[E.absent(c.cast("double")).alias(f"v{k}") for k, c in enumerate(columns.values())])
    whole = v.agg(*[f(f"v{k}").alias(f"{f.__name__}{k}") for k in range(len(columns)) for f in (F.count, F.min, F.max)]).first()
    places = {k: [(whole[f"count{k}"] - 1) * s for s in shares] for k in range(len(columns)) if whole[f"count{k}"]}
    # (column, rank) -> (low, high, values below low)
    found = {(k, rank): (whole[f"min{k}"], whole[f"max{k}"], 0) for k, ps in places.items() for p in ps for rank in {math.floor(p), math.ceil(p)}}
    while spans := sorted({(k, low, high) for (k, _), (low, high, _) in found.items() if low < high}):
        rows = []
        for i, (k, low, high) in enumerate(spans):
            x = F.col(f"v{k}")
            # Halves do not overflow; two neighbouring numbers have none between them.
            width = high / 2 - low / 2
            share = (x / 2 - low / 2) / width if width else F.when(x > low, 1.0).otherwise(0.0)
            digit = F.greatest(F.lit(0), F.least(F.lit(DIGITS - 1), F.floor(share * DIGITS))).cast("int")
            rows.append(F.when(x.between(low, high), F.struct(F.lit(i).alias("span"), digit.alias("digit"), x.alias("v"))))
        buckets = v.select(F.explode(F.array(*rows)).alias("x")).where("x is not null").groupBy("x.span", "x.digit")
        per: dict[int, list] = {}
        for r in buckets.agg(F.count("x.v").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high")).collect():
            per.setdefault(r["span"], []).append((r["digit"], r["n"], r["low"], r["high"]))
        for (k, rank), (low, high, below) in list(found.items()):
            if low < high:
                for _, n, a, b in sorted(per[spans.index((k, low, high))]):
                    if rank < below + n:
                        found[k, rank] = (a, b, below)
                        break
                    below += n
    value = lambda k, rank: found[k, rank][0]
    between = lambda k, p: (a := value(k, math.floor(p))) + (value(k, math.ceil(p)) - a) * (p - math.floor(p))
    return {name: [between(k, p) for p in places[k]] if k in places else [None] * len(shares) for k, name in enumerate(columns)}


def percentiles(values: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: a column's values at the shares as q0, q1, ..."""
    found = exact_percentiles(values, {value: F.col(value)}, shares)[value]
    return values.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(f"q{k}") for k, x in enumerate(found)])


def _levels(value: str, limits: list[float | None]) -> Column:
    """0..255 between two limits, 0 where absent."""
    v, (lo, hi) = E.absent(value), limits
    if lo is None or hi is None:
        return F.lit(0)
    hi = lo + 1 if hi <= lo else hi
    scaled = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))) * 255).cast("int")
    return F.coalesce(scaled, F.lit(0))


def stretched(scene: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98) -> dict[str, Column]:
    """For each band its levels between two percentiles of the finite positive values, which are found for all bands at once."""
    positive = lambda k: (x := E.absent(k), F.when(x > 0, x))[1]
    limits = exact_percentiles(scene, {k: positive(k) for k in bands}, [low, high])
    return {k: _levels(k, limits[k]) for k in bands}


def stretch(band: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds ``level``: 0..255 between two percentiles of the finite positive values, 0 where absent."""
    return band.withColumn("level", stretched(band, [value], low, high)[value])


def true_colour(scene: DataFrame) -> DataFrame:
    """r, c, red, green, blue levels: the scene's 8-bit rendering (visual_r, visual_g, visual_b) where it has one, else its stretched bands."""
    names = ["red", "green", "blue"]
    if all(f"visual_{k}" in scene.columns for k in "rgb"):
        return scene.select(*PIXEL, *[F.col(f"visual_{k[0]}").cast("int").alias(k) for k in names])
    return scene.select(*PIXEL, *[v.alias(k) for k, v in stretched(scene, names).items()])


def chip_db(db: Column, low: float = -25.0, high: float = 0.0) -> Column:
    return F.coalesce(F.floor((F.least(F.greatest(db, F.lit(low)), F.lit(high)) - low) / (high - low) * 255), F.lit(0)).cast("int")


def resample(source: DataFrame, target: DataFrame, value: str, scale: float, nearest: bool = False) -> DataFrame:
    """Values of a finer or coarser grid: target pixel centres map to source coordinates; four weighted neighbours are joined by key."""
    y, x = (F.col("r") + 0.5) * scale - 0.5, (F.col("c") + 0.5) * scale - 0.5
    t = target.select("r", "c", y.alias("y"), x.alias("x"))
    if nearest:
        t = t.withColumns({"sr": F.floor((F.col("r") + 0.5) * scale).cast("int"), "sc": F.floor((F.col("c") + 0.5) * scale).cast("int")})
        return t.join(source.select(F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["sr", "sc"]).select("r", "c", value)
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    corner = lambda dy, dx, w: F.struct((F.floor("y") + dy).cast("int").alias("sr"), (F.floor("x") + dx).cast("int").alias("sc"), w.alias("w"))
    near = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    s = source.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("v"))
    return (
        t.select("r", "c", F.inline(near))
        .where("w > 0")
        .join(s, ["sr", "sc"])
        .groupBy("r", "c")
        .agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(value))
    )


def phase_correlation(before: DataFrame, after: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """dy, dx, sharpness of every circular shift: how far ``after`` lies from ``before``; rolling it by (-dy, -dx) aligns it. Sharpness is 1 for an exact copy.

    The Fourier transforms run over rows, then over columns, and back, so a task holds single rows or columns. NULL, NaN and absent pixels count as the plane's mean.
    """
    ship(before.sparkSession)
    v = E.absent(F.col(value).cast("double"))
    px = [df.select(F.lit(k).alias("plane"), "r", "c", v.alias("v")) for k, df in enumerate((before, after))]
    px = px[0].union(px[1])
    mean = F.broadcast(px.groupBy("plane").agg(F.avg("v").alias("m")))
    px = px.join(mean, "plane").select("plane", "r", "c", (F.col("v") - F.col("m")).alias("v")).where("v is not null")

    def rows(df):
        line = np.zeros(width)
        line[df["c"]] = df["v"]
        f = np.fft.fft(line)
        return pd.DataFrame({"plane": df["plane"].iloc[0], "r": df["r"].iloc[0], "k": np.arange(width), "re": f.real, "im": f.imag})

    def columns(df):
        lines = np.zeros((2, height), complex)
        lines[df["plane"], df["r"]] = df["re"] + 1j * df["im"]
        a, b = np.fft.fft(lines)
        size = np.abs(a) * np.abs(b)
        cross = np.divide(b * a.conj(), size, out=np.zeros(height, complex), where=size > 1e-18)
        f = np.fft.ifft(cross)
        return pd.DataFrame({"k": df["k"].iloc[0], "y": np.arange(height), "re": f.real, "im": f.imag})

    def back(df):
        line = np.zeros(width, complex)
        line[df["k"]] = df["re"] + 1j * df["im"]
        return pd.DataFrame({"y": df["y"].iloc[0], "x": np.arange(width), "sharpness": np.fft.ifft(line).real})

    f = px.groupBy("plane", "r").applyInPandas(rows, "plane int, r int, k int, re double, im double")
    f = f.groupBy("k").applyInPandas(columns, "k int, y int, re double, im double")
    f = f.groupBy("y").applyInPandas(back, "y int, x int, sharpness double")
    signed = lambda x, n: F.when(F.col(x) > n // 2, F.col(x) - n).otherwise(F.col(x))
    return f.select(signed("y", height).alias("dy"), signed("x", width).alias("dx"), "sharpness")


def estimate_shift(before: DataFrame, after: DataFrame, value: str, height: int, width: int, most: int = 32) -> DataFrame:
    """The sharpest of all shifts, and whether it is within ``most`` pixels on both axes; beyond that it must not be applied."""
    found = phase_correlation(before, after, value, height, width)
    best = found.orderBy(F.desc("sharpness"), F.abs("dy") + F.abs("dx"), "dy", "dx").limit(1)
    return best.withColumn("within_tolerance", F.greatest(F.abs("dy"), F.abs("dx")) <= most)
