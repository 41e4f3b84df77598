"""Region operators: components, sieve, cap, zonal statistics, dating, features, provenance, rings.

Components are labelled tile by tile (``applyInPandas``, at most TILE x TILE pixels a group), then labels that touch across tile borders are
merged by star contraction, so no task ever holds a whole mask. A component's label is its smallest pixel number r * width + c. A component may be as
large as the image: its pixels are counted and averaged with partial aggregation, and joins on labels are split by adaptive skew joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E
from rasterflux.operators.graph import connected, numbered
from rasterflux.shipping import ship
from rasterflux.storage import discard, materialize

TILE = 256
MAX_REGIONS = 2000


def _tile_labels(width: int, eight: bool):
    """Labels the pixels of a tile by their runs: runs of neighbouring rows that touch are merged to their first one by rounds of minima."""
    pad = 1 if eight else 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True)
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(r)) - 1
        row, far = r[first], np.int64(width + 4)
        # Runs of the next row that reach from this run's start to its end.
        low = np.searchsorted(row * far + c[last] + 1, (row + 1) * far + c[first] + 1 - pad, "left")
        high = np.searchsorted(row * far + c[first] + 1, (row + 1) * far + c[last] + 1 + pad, "right")
        n = np.maximum(high - low, 0)
        a = np.repeat(np.arange(len(first)), n)
        b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        root = np.arange(len(first))
        while True:
            before = root.copy()
            least = np.minimum(root[a], root[b])
            for side in (a, b):
                np.minimum.at(root, before[side], least)
                np.minimum.at(root, side, least)
            root = root[root]
            if (root == before).all():
                break
        label = (row * width + c[first])[root]
        return pdf.assign(label=label[np.cumsum(new) - 1]).drop(columns=["tr", "tc"])

    return run


def components(mask: DataFrame, width: int, height: int, eight: bool = True, keys: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """keys, r, c, label of the true pixels of one mask per key."""
    keys = keys or []
    ship(mask.sparkSession)
    tiled = mask.select(*keys, "r", "c", F.expr(f"r div {tile}").alias("tr"), F.expr(f"c div {tile}").alias("tc"))
    fields = [f"{k} {mask.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, "r int", "c int", "label long"])
    labelled = tiled.groupBy(*keys, "tr", "tc").applyInPandas(_tile_labels(width, eight), schema)
    if width <= tile and height <= tile:
        return labelled
    labelled = materialize(labelled, "labels")
    # Pixels on the first row or column of a tile meet their neighbours in the tiles before.
    reach = [(-1, 0), (0, -1)] + ([(-1, -1), (-1, 1), (1, -1)] if eight else [])
    edge = labelled.where(f"r % {tile} = 0 or c % {tile} = 0 or c % {tile} = {tile - 1} or r % {tile} = {tile - 1}")
    step = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in reach])
    met = edge.select(*keys, "r", "c", F.col("label").alias("a"), F.inline(step)).select(
        *keys, (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "a"
    )
    met = met.join(edge.withColumnRenamed("label", "b"), [*keys, "r", "c"]).where("a != b")
    if not keys:
        roots = connected(met.select("a", "b"))
        return labelled.join(roots, labelled["label"] == roots["node"], "left").select("r", "c", F.coalesce("root", "label").alias("label"))
    # One graph for all keys: a node is the key's hash with the label.
    node = lambda c: F.xxhash64(*keys, c)
    names = met.select(*keys, F.explode(F.array("a", "b")).alias("label")).distinct().withColumn("id", node("label"))
    roots = connected(met.select(node("a").alias("a"), node("b").alias("b")))
    merged = names.join(roots, names["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    least = merged.withColumn("least", F.min("label").over(W.partitionBy("root"))).select(*keys, "label", "least")
    return labelled.join(least, [*keys, "label"], "left").select(*keys, "r", "c", F.coalesce("least", "label").alias("label"))


def sizes(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return labelled.groupBy(*(keys or []), "label").agg(F.count(F.lit(1)).alias("pixels"))


def sieved(mask: DataFrame, size: int, width: int, height: int, keys: list[str] | None = None) -> DataFrame:
    """keys, r, c, label of the true pixels in 4-connected patches of at least ``size``."""
    keys = keys or []
    lab = components(mask, width, height, eight=False, keys=keys)
    if size <= 1:
        return lab
    lab = materialize(lab, "patches")
    big = sizes(lab, keys).where(F.col("pixels") >= size).select(*keys, "label")
    return lab.join(big, [*keys, "label"], "left_semi").select(*keys, "r", "c", "label")


def sieve_drop(mask: DataFrame, size: int, width: int, height: int, keys: list[str] | None = None) -> DataFrame:
    """True pixels in 4-connected patches of at least ``size``."""
    return mask if size <= 1 else sieved(mask, size, width, height, keys).drop("label")


def sieve_merge(dense: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Two-valued sieve of a dense grid (r, c, on): every small patch of either value takes the value of its largest neighbour, small ones
    following theirs to a large one; without one they stay."""
    # The background is a hot label: it is only counted and joined with few rows, never grouped whole.
    lab = materialize(components(dense.select("on", "r", "c"), width, height, eight=False, keys=["on"]), "sieve")
    n = lab.groupBy("on", "label").agg(F.count(F.lit(1)).alias("n"))
    step = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    near = lab.select("on", "label", "r", "c", F.inline(step)).select(
        "on", "label", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")
    )
    other = lab.join(n, ["on", "label"]).select("r", "c", F.col("on").alias("o2"), F.col("label").alias("l2"), F.col("n").alias("n2"))
    best = near.join(other, ["r", "c"]).where("o2 != on").groupBy("on", "label").agg(F.max(F.struct("n2", (-F.col("l2")).alias("k"), "o2", "l2")).alias("b"))
    small = n.where(F.col("n") < size).join(best, ["on", "label"], "left")
    chain = small.select("on", "label", F.col("b.o2").alias("to_on"), F.col("b.l2").alias("to"), F.col("b.n2").alias("to_n"))
    big = resolved(chain, size)
    return lab.join(big, ["on", "label"], "left").select("r", "c", F.coalesce("new", "on").alias("on"))


def resolved(chain: DataFrame, size: int) -> DataFrame:
    """on, label, new: the value at the end of each patch's chain of neighbours, where that end is large.

    Pointers are doubled: what a patch points to is replaced by what that points to, so a chain of 2^k patches takes k rounds. Patches of a circle of small ones never arrive.
    """
    state = materialize(chain.where("to is not null").select("on", "label", "to_on", "to", F.when(F.col("to_n") >= size, F.col("to_on")).alias("new")), "chain")
    open_ = state.where("new is null").count()
    while open_:
        ahead = state.select(F.col("on").alias("to_on"), F.col("label").alias("to"), F.col("to_on").alias("far_on"), F.col("to").alias("far"), F.col("new").alias("far_new"))
        moved = state.where("new is null").join(ahead, ["to_on", "to"]).select("on", "label", F.col("far_on").alias("to_on"), F.col("far").alias("to"), F.col("far_new").alias("new"))
        older, state = state, materialize(state.where("new is not null").unionByName(moved), "chain")
        discard(older)
        # A chain has patches at every distance, so a round that resolves none is the last.
        still = state.where("new is null").count()
        if still == open_:
            break
        open_ = still
    return state.where("new is not null").select("on", "label", "new")


def region_cap(region_sizes: DataFrame, limit: int = MAX_REGIONS) -> DataFrame:
    """Regions at least as large as the limit-th largest, ties kept, and how many were dropped.

    The cut-off is found by counting regions per size, so the ranked table has one row per distinct size.
    """
    per = region_sizes.groupBy("pixels").agg(F.count(F.lit(1)).alias("n"))
    above = W.orderBy(F.desc("pixels")).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("kept", F.coalesce(F.sum("n").over(above), F.lit(0)) < limit)
    cut = per.agg(F.min(F.when(F.col("kept"), F.col("pixels"))).alias("cutoff"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("n"))), F.lit(0)).alias("dropped"))
    return region_sizes.crossJoin(F.broadcast(cut)).where("pixels >= cutoff").drop("cutoff")


def region_stats(labelled: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Pixels, means (absent counts as 0), bounding box and elongation of each label."""
    extent = lambda x: F.max(x) - F.min(x) + 1
    h, w = extent("r"), extent("c")
    return labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("pixels"),
        *[F.avg(F.coalesce(v, F.lit(0.0))).alias(v) for v in values],
        (F.greatest(h, w) / F.least(h, w)).cast("double").alias("elongation"),
    )


def region_dating(labelled: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """Modal change index (ties: smallest; none: -1) and the half-even mean of confirmations over all pixels of a region. Persistence only where dated."""
    px = labelled.join(change, ["r", "c"], "left")
    ci = F.mode(F.when(F.col("change_index") >= 0, F.col("change_index")), True)
    mean = F.rint(F.avg(F.coalesce("confirmations", F.lit(0)))).cast("int")
    out = px.groupBy(*keys, "label").agg(F.coalesce(ci, F.lit(-1)).cast("int").alias("change_index"), mean.alias("confirmed_by"))
    known = F.when(F.col("confirmed_by") > 0, "confirmed").otherwise("unconfirmed (latest observation)")
    return out.withColumn("persistence", F.when(F.col("change_index") >= 0, known))


def dated(regions: DataFrame, labelled: DataFrame, optical: DataFrame | None, radar: DataFrame | None, used: DataFrame, keys: list[str]) -> DataFrame:
    """Adds change_date, dated_by, confirmed_by and persistence: by the optical dates where these saw the change, else by the radar dates, else none.

    ``optical`` and ``radar`` are (r, c, change_index, confirmations) over each sensor's later dates; ``used`` the run's scenes with their ordinals.
    """
    out = regions
    for sensor, change in (("S2", optical), ("S1", radar)):
        if change is None:
            out = out.withColumns({f"_date_{sensor}": F.lit(None).cast("date"), f"_by_{sensor}": F.lit(None).cast("int")})
            continue
        found = region_dating(labelled, change, keys).select(*keys, "label", (F.col("change_index") + 1).alias("_at"), F.col("confirmed_by").alias(f"_by_{sensor}"))
        # At most the dates of a run; ordinal 0 is the baseline, which dates nothing.
        days = F.broadcast(used.where((F.col("sensor") == sensor) & (F.col("ordinal") > 0)).select(F.col("ordinal").alias("_at"), F.col("date").alias(f"_date_{sensor}")))
        out = out.join(found.join(days, "_at", "left").drop("_at"), [*keys, "label"], "left")
    by_optical, by_radar = F.col("_date_S2").isNotNull(), F.col("_date_S1").isNotNull()
    confirmed = F.when(by_optical, F.col("_by_S2")).when(by_radar, F.col("_by_S1"))
    return out.withColumns(
        {
            "change_date": F.coalesce("_date_S2", "_date_S1"),
            "dated_by": F.when(by_optical, "optical").when(by_radar, "radar"),
            "confirmed_by": confirmed,
            "persistence": F.when(confirmed > 0, "confirmed").when(confirmed.isNotNull(), "unconfirmed (latest observation)"),
        }
    ).drop("_date_S2", "_date_S1", "_by_S2", "_by_S1")


def provenance(regions: DataFrame, used: DataFrame) -> DataFrame:
    """Adds the scenes behind each region, per sensor: before is the sensor's first; after the one of the change date if that sensor dated the region, else its last; and the first radar scene's orbit.

    ``used`` is the run's short list of scenes (sensor, date, id, relative_orbit; at most steps x sensors rows). A sensor without scenes adds NULLs.
    """
    names = {"S2": ("optical", "scene", "date"), "S1": ("radar", "sar_scene", "sar_date")}
    order = F.struct("date", "id")
    out = regions
    for sensor, (by, scene, day) in names.items():
        mine = used.where(F.col("sensor") == sensor)
        ends = mine.agg(F.min_by(F.struct("id", "date", "relative_orbit"), order).alias("_first"), F.max_by(F.struct("id", "date"), order).alias("_last"))
        at = mine.groupBy(F.col("date").alias("_day")).agg(F.min("id").alias("_at"))
        dates = F.when(F.col("dated_by") == by, F.col("change_date"))
        out = out.crossJoin(F.broadcast(ends)).withColumn("_when", dates).join(F.broadcast(at), F.col("_when") == F.col("_day"), "left")
        after = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("id"), F.col("_when").alias("date"))).otherwise(F.col("_last"))
        out = out.withColumns({f"{scene}_before": F.col("_first.id"), f"{day}_before": F.col("_first.date"), f"{scene}_after": after["id"], f"{day}_after": after["date"]})
        if sensor == "S1":
            out = out.withColumn("relative_orbit", F.col("_first.relative_orbit"))
        out = out.drop("_first", "_last", "_when", "_day", "_at")
    return out


def trim(features: DataFrame, limit: int = MAX_REGIONS) -> DataFrame:
    """The ``limit`` largest features (ties in the order of emission, ``id``), each with ``trimmed``, how many are left out: one label may have several pieces."""
    ranked = numbered(features, [F.desc("area_ha"), F.col("id")])
    whole = ranked.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("trimmed"))
    return ranked.where(F.col("number") <= limit).drop("number").crossJoin(F.broadcast(whole))


def features(
    pieces: DataFrame, fused: DataFrame, width: int, height: int, pixel_area_m2: float = 100.0, limit: int = MAX_REGIONS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classified features, the labelled pixels of their regions, and one row with ``dropped``.

    ``pieces`` are the sieved 4-connected patches (tier, direction, r, c, label). A region is 8-connected and has the statistics; each of its pieces is a feature, whose
    area is its own. ``fused`` has d1 and the planes ndvi, ndwi and ndbi, which are averaged over all pixels of a region, absent ones as 0. Properties of a sensor that could
    not see the region are absent, not 0.
    """
    keys = ["tier", "direction"]
    # Labels and statistics are read several times: by the cap, the pieces, the dates.
    lab = materialize(components(pieces.select(*keys, "r", "c"), width, height, True, keys), "regions")
    planes = ["ndvi", "ndwi", "ndbi"]
    values = fused.select("r", "c", *planes, F.col("d1").alias("sar_db"))
    stats = region_stats(lab.join(values, ["r", "c"]), [*planes, "sar_db"], keys)
    # Nine places, so that the order in which tasks add up does not decide a rule.
    stats = materialize(stats.withColumns({k: F.round(k, 9) for k in [*planes, "sar_db"]}), "region-stats")
    capped = region_cap(stats, limit)
    dropped = capped.agg(F.coalesce(F.max("dropped"), F.lit(0)).alias("dropped"))
    seen = capped.withColumns({"has_optical": F.col("tier").isin("confirmed", "optical", "sar_only"), "has_sar": F.col("tier").isin("confirmed", "sar_only", "sar_gap")})
    seen = seen.withColumn("k", E.classify()).withColumnRenamed("pixels", "region_pixels")
    both = pieces.withColumnRenamed("label", "piece").join(lab, [*keys, "r", "c"])
    per_piece = both.groupBy(*keys, "label", "piece").agg(F.count(F.lit(1)).alias("pixels"))
    out = per_piece.join(seen, [*keys, "label"])
    delta = lambda c, flag, n: F.when(F.col(flag), F.round(c, n)).alias(f"{c}_delta")
    why = E.reason("k.change_type", "k.confidence")
    out = out.select(
        *keys, "label", "piece", "pixels", "region_pixels", F.round(E.hectares("pixels", pixel_area_m2), 4).alias("area_ha"), "elongation", "k.change_type", "k.confidence",
        E.label("k.change_type").alias("change_label"), E.evidence(*planes, "sar_db", "has_optical", "has_sar", why).alias("evidence"),
        *[delta(c, "has_optical", 3) for c in planes], delta("sar_db", "has_sar", 2),
    )
    return out, lab, dropped


def emitted(features_: DataFrame) -> DataFrame:
    """Adds ``id``, the feature's position: by tier, loss before gain, region and piece."""
    tier = F.array_position(F.array(*[F.lit(t) for t in E.TIERS]), F.col("tier"))
    return numbered(features_, [tier, F.desc("direction"), F.col("label"), F.col("piece")]).withColumn("id", F.col("number") - 1).drop("number")


def boundary(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label and the directed edges (r1, c1) to (r2, c2) between its pixels and others, the inside on the right; a large region's inner pixels stay where they are."""
    side = lambda dr, dc, a, b: F.struct(
        (F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc"),
        (F.col("r") + a[0]).alias("r1"), (F.col("c") + a[1]).alias("c1"), (F.col("r") + b[0]).alias("r2"), (F.col("c") + b[1]).alias("c2"),
    )
    sides = F.array(side(-1, 0, (0, 0), (0, 1)), side(0, 1, (0, 1), (1, 1)), side(1, 0, (1, 1), (1, 0)), side(0, -1, (1, 0), (0, 0)))
    edges = labelled.select(*keys, "label", F.inline(sides))
    inside = labelled.select(*keys, "label", F.col("r").alias("nr"), F.col("c").alias("nc"))
    return edges.join(inside, [*keys, "label", "nr", "nc"], "left_anti").drop("nr", "nc")


def _rings(edges: Iterator[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Closed rings of corner points from directed boundary edges."""
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r1, c1, r2, c2 in sorted(edges):
        follow.setdefault((r1, c1), []).append((r2, c2))
    # Corners in ascending order; each ring starts at the least that is left.
    for start in sorted(follow):
        while follow.get(start):
            ring, at, came = [start], start, None
            while True:
                options = follow[at]
                # Where two pixels of a piece meet at a corner, the turn away from the inside keeps holes apart.
                if came and len(options) > 1:
                    options.sort(key=lambda p: came[1] * (p[0] - at[0]) - came[0] * (p[1] - at[1]))
                to = options.pop(0)
                came, at = (to[0] - at[0], to[1] - at[1]), to
                ring.append(at)
                if at == start:
                    break
            yield [p for k, p in enumerate(ring) if k in (0, len(ring) - 1) or not _straight(ring[k - 1], p, ring[k + 1])]


def _straight(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> bool:
    return (b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0])


def rings(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Per 4-connected label: its rings as arrays of [column, row] corners, the outer first. A task's group is a region's boundary, not its pixels."""
    ship(labelled.sparkSession)
    labelled = materialize(labelled, "rings")
    fields = ", ".join([f"{k} {labelled.schema[k].dataType.simpleString()}" for k in keys] + ["label long, rings array<array<array<int>>>"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = zip(*(pdf[x].tolist() for x in ("r1", "c1", "r2", "c2")), strict=True)
        found = [[[c, r] for r, c in ring] for ring in _rings(edges)]
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"label": pdf["label"].iloc[0], "rings": found}])

    out = boundary(labelled, keys).groupBy(*keys, "label").applyInPandas(run, fields)
    return out.join(sizes(labelled, keys), [*keys, "label"])


def in_degrees(ringed: DataFrame, keys: list[str], left: float, top: float, res: float, epsg: int) -> DataFrame:
    """Adds ``coordinates``, the rings in WGS84 to six places, from a projected grid's origin and resolution."""
    points = ringed.select(*keys, F.posexplode("rings").alias("k", "ring")).select(*keys, "k", F.posexplode("ring").alias("i", "p"))
    lon, lat = E.utm_inverse(left + F.col("p")[0] * res, top - F.col("p")[1] * res, F.lit(epsg))
    points = points.select(*keys, "k", F.struct("i", F.array(F.round(lon, 6), F.round(lat, 6)).alias("xy")).alias("v"))
    ring = points.groupBy(*keys, "k").agg(F.transform(F.sort_array(F.collect_list("v")), lambda v: v["xy"]).alias("ring"))
    whole = ring.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ring"))), lambda v: v["ring"]).alias("coordinates"))
    return ringed.join(whole, keys)


def to_feature(columns: list[str], geometry: Column) -> Column:
    """A GeoJSON feature; absent properties are left out."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*columns).alias("properties")))
