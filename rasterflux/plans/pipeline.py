"""Entry points: pair, series, single-index detection, drone comparison. Each returns tables of features and run statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E
from rasterflux.functions import grids as G
from rasterflux.operators import change as C
from rasterflux.operators import regions as R
from rasterflux.operators import scenes as S
from rasterflux.plans.params import Params, check_grid
from rasterflux.storage import materialize

NO_OPTICAL = "no usable optical scenes: the result is radar only"
NO_RADAR = "no usable radar scenes: the result is optical only"
PLANES = ("ndvi", "ndwi", "ndbi")
USED = "sensor string, step int, ordinal int, date date, id long, relative_orbit int"


@dataclass
class Run:
    """Fused pixels, features (``regions``), one row of statistics with warnings, and notes on sensors that are missing."""

    pixels: DataFrame
    regions: DataFrame
    stats: DataFrame
    notes: list[str] = field(default_factory=list)
    pieces: DataFrame | None = None


def load_optical(px: DataFrame) -> DataFrame:
    """All three indices, validity and whether the pixel was never imaged, from one scan of four bands and the class band; a missing band raises."""
    if missing := [b for b in ("red", "nir", "green", "swir16", "scl") if b not in px.columns]:
        raise ValueError(f"the scene is missing {', '.join(missing)}")
    return px.select("r", "c", "step", *[E.named_index(k).alias(k) for k in PLANES], E.scl_valid("scl").alias("ok"), F.coalesce(F.col("scl") == 0, F.lit(False)).alias("never"))


def load_radar(px: DataFrame, grid: DataFrame, height: int, width: int, step: int, speckle: int = 5, pol: str = "vv") -> DataFrame:
    """One date in dB after the speckle filter, of the polarization's band (``gamma0_vv``, ``gamma0_vh``; ``gamma0`` where there is one only); valid is what the filter could fill."""
    band = f"gamma0_{pol}" if f"gamma0_{pol}" in px.columns else "gamma0"
    if pol not in ("vv", "vh") or band not in px.columns:
        raise ValueError(f"no polarization {pol!r}")
    db = px.where(F.col("step") == step).select("r", "c", E.to_db(band).alias("db"))
    dense = grid.join(db, ["r", "c"], "left").select("r", "c", "db")
    out = C.boxcar(dense, "db", speckle, height, width)
    return out.select("r", "c", F.lit(step).alias("step"), "db", F.col("db").isNotNull().alias("ok"))


def used_scenes(scenes: DataFrame, windows: DataFrame, p: Params, box: S.Box | None = None) -> DataFrame:
    """One scene per sensor and window, numbered per sensor in the order of the windows: the clearest optical one under the cloud limit, the newest descending radar one."""
    sound = scenes.where((F.col("sensor") == "S1") | (F.col("cloud_cover") < p.max_cloud)).where(S.meets(box))
    best = S.best_per_window(sound, windows)
    order = F.row_number().over(C.W.partitionBy("sensor").orderBy("step")) - 1
    return best.select("sensor", "step", order.alias("ordinal"), "date", "id", "relative_orbit", "cloud_cover")


def load_radar_pair(px: DataFrame, grid: DataFrame, height: int, width: int, before: int, after: int, p: Params, speckle: int = 5) -> DataFrame:
    """Two dates of the parameters' polarization as steps 0 and 1 of a pair run, each in dB after the speckle filter."""
    one = lambda step, to: load_radar(px, grid, height, width, step, speckle, p.pol).withColumn("step", F.lit(to))
    return one(before, 0).unionByName(one(after, 1))


def pair_scenes(scenes: DataFrame, before: tuple[str, str], after: tuple[str, str], p: Params, box: S.Box | None = None) -> DataFrame:
    """The scenes of a pair run, one per sensor and side (step 0 and 1), from two spans of dates, both inclusive: the clearest optical ones under the cloud limit and the newest descending radar
    ones. With ``match_orbit`` the radar scenes share a relative orbit, the newest before scene that has a partner; without one this raises when read.
    """
    sound = scenes.where((F.col("sensor") == "S1") | (F.col("cloud_cover") < p.max_cloud)).where(S.meets(box))
    spans = scenes.sparkSession.createDataFrame([(0, *before), (1, *after)], "window int, s string, e string")
    spans = spans.select("window", F.to_date("s").alias("window_start"), F.to_date("e").alias("window_end"))
    best = S.best_per_window(sound, spans)
    if p.match_orbit:
        radar = sound.where((F.col("sensor") == "S1") & (F.col("orbit_state") == "descending"))
        of = lambda span: radar.where(F.col("date").between(*span)).select("id", "date", "relative_orbit")
        pair = S.orbit_pair(of(before), of(after)).select(F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("before_id").alias("id")), F.struct(F.lit(1).alias("step"), F.col("after_id").alias("id")))).alias("x"))
        matched = radar.join(F.broadcast(pair.select("x.step", "x.id")), "id").select("sensor", "step", "id", "date", F.lit(None).cast("double").alias("cloud_cover"), "relative_orbit")
        best = best.where("sensor = 'S2'").unionByName(matched)
    return best.select("sensor", "step", F.col("step").alias("ordinal"), "date", "id", "relative_orbit", "cloud_cover")


def _stats(fused: DataFrame, pieces: DataFrame, dropped: DataFrame, trimmed: DataFrame, p: Params) -> DataFrame:
    """Coverage, hectares per tier from the sieved masks, what the caps left out, and warnings, in one row."""
    cover = C.coverage_warnings(C.coverage(fused, F.col("never")))
    ha = C.tier_hectares(pieces.select("tier"), p.pixel_area_m2).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tier", "hectares")))).alias("hectares"))
    out = cover.crossJoin(F.broadcast(ha)).crossJoin(F.broadcast(dropped)).crossJoin(F.broadcast(trimmed))
    out = out.withColumn("dropped", F.col("dropped") + F.col("trimmed")).drop("trimmed")
    note = F.when(F.col("dropped") > 0, F.format_string("%d smaller regions are counted in the hectares but not listed", "dropped"))
    return out.withColumn("warnings", F.concat("warnings", F.array_compact(F.array(note))))


def _fuse(grid: DataFrame, optical: DataFrame | None, radar: DataFrame | None, p: Params) -> tuple[DataFrame, list[str]]:
    """The fused grid, written once, as regions and statistics both read it."""
    if optical is None and radar is None:
        raise ValueError("no usable scenes from either sensor")
    spark, notes = grid.sparkSession, []
    if optical is None:
        optical = spark.createDataFrame([], "r int, c int, diff double, valid boolean, never boolean, ndvi double, ndwi double, ndbi double")
        notes.append(NO_OPTICAL)
    if radar is None:
        radar = spark.createDataFrame([], "r int, c int, diff double, valid boolean")
        notes.append(NO_RADAR)
    fused = C.fuse(grid, optical, radar).withColumn("never", F.coalesce("never", F.lit(False)))
    fused = fused.withColumn("tier", E.tier("d2", "v2", "d1", "v1", p.optical_threshold, p.sar_threshold_db))
    return materialize(fused.withColumn("direction", E.tier_direction("tier", "d2", "d1")), "fused"), notes


def _finish(
    fused: DataFrame, notes: list[str], height: int, width: int, p: Params, used: DataFrame | None, optical: DataFrame | None, radar: DataFrame | None, limit: int
) -> Run:
    keys = ["tier", "direction"]
    pieces = materialize(R.sieved(fused.where("tier is not null").select(*keys, "r", "c"), p.sieve, width, height, keys), "pieces")
    found, lab, dropped = R.features(pieces, fused, width, height, p.pixel_area_m2, limit)
    if used is None:
        used = fused.sparkSession.createDataFrame([], USED)
    found = R.dated(found, lab, optical, radar, used, keys)
    found = materialize(R.emitted(R.provenance(found, used)), "features")
    kept = R.trim(found, limit)
    trimmed = found.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("trimmed"))
    return Run(fused, kept.drop("trimmed"), _stats(fused, pieces, dropped, trimmed, p), notes, pieces)


def run_pair(
    grid: DataFrame, optical: DataFrame | None, radar: DataFrame | None, height: int, width: int, p: Params, used: DataFrame | None = None, limit: int = R.MAX_REGIONS
) -> Run:
    """Two dates, steps 0 and 1: optical (r, c, step, ndvi, ndwi, ndbi, ok[, never]), radar (r, c, step, db, ok); ``used`` are their scenes (see USED). Pairs are not dated."""
    check_grid(width, height)
    never = None if optical is None else F.col("never") if "never" in optical.columns else F.lit(False)
    planes = {k: F.col(k) for k in PLANES}
    o = optical and C.pair_diff(optical, {"diff": F.col(p.index), **planes}, F.col("ok"), 0, 1, never)
    s = radar and C.pair_diff(radar, {"diff": F.col("db")}, F.col("ok"), 0, 1)
    fused, notes = _fuse(grid, o, s, p)
    return _finish(fused, notes, height, width, p, used, None, None, limit)


def _dates(px: DataFrame | None) -> list[int]:
    """The steps that a sensor has: at most ``steps`` of them."""
    return [] if px is None else sorted(r[0] for r in px.select("step").distinct().collect())


def run_series(
    grid: DataFrame, optical: DataFrame | None, radar: DataFrame | None, height: int, width: int, p: Params, used: DataFrame | None = None, limit: int = R.MAX_REGIONS
) -> Run:
    """Baseline-anchored series over the steps that each sensor has; at least two dates of one sensor are needed, and a sensor with fewer is left out with a note.

    The baseline is the sensor's first usable date. Optical change is dated by persistence; where it is, radar is taken at the same ordinal of its own later
    dates (clipped to the last), else its own signed value. Transient pixels carry 0, so noise does not reach the fusion.
    """
    check_grid(width, height)
    notes, o, s, oc, rc = [], None, None, None, None
    seen_on, echo_on = _dates(optical), _dates(radar)
    if optical is not None and len(seen_on) < 2:
        optical = None
        notes.append("fewer than two usable optical dates")
    if radar is not None and len(echo_on) < 2:
        radar = None
        notes.append("fewer than two usable radar dates")
    if optical is None and radar is None:
        raise ValueError("at least two usable dates of one sensor are needed")
    if optical is not None:
        # The planes come with the change that dates them.
        stack = C.baseline_diff(optical, {k: k for k in PLANES}, "ok", dates=seen_on).withColumn("diff", F.col(p.index))
        oc = materialize(C.persistence(stack, p.optical_threshold, p.min_persist, carry=PLANES), "optical-change")
        never = F.lit(False) if "never" not in optical.columns else F.col("never")
        seen = optical.groupBy("r", "c").agg(F.bool_or(never).alias("never"))
        o = oc.join(seen, ["r", "c"], "left")
        o = o.select("r", "c", F.col("signed").alias("diff"), F.col("observed").alias("valid"), "never", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in PLANES])
    if radar is not None:
        rs = materialize(C.baseline_diff(radar, {"diff": "db"}, "ok", dates=echo_on), "radar-stack")
        rc = materialize(C.persistence(rs, p.sar_threshold_db, p.min_persist), "radar-change")
        s = rc.select("r", "c", F.col("signed").alias("diff"), F.col("observed").alias("valid"))
        if oc is not None:
            at = C.plane_at(rs.select("r", "c", "t", F.col("diff").alias("db")), oc, "db", len(echo_on) - 2)
            s = s.join(at, ["r", "c"], "left").select(
                "r", "c", F.when(F.col("change_index") >= 0, F.col("db")).otherwise(F.col("diff")).alias("diff"), "valid"
            )
    fused, more = _fuse(grid, o, s, p)
    slim = lambda x: x if x is None else x.select("r", "c", "change_index", "confirmations")
    run = _finish(fused, notes + more, height, width, p, used, slim(oc), slim(rc), limit)
    count = lambda c: F.count_if(F.col(c)).alias(c)
    series = (oc if oc is not None else rc).agg(count("changed"), count("persistent"), count("latest"), count("transient"))
    stats = run.stats.crossJoin(F.broadcast(series))
    run.stats = stats.withColumn("transient_ha", F.round(E.hectares("transient", p.pixel_area_m2), 2))
    return run


def detect(
    diff: DataFrame, height: int, width: int, threshold: float, sieve: int = 50, pixel_area_m2: float = 100.0, least_clear: float = 0.5, limit: int = R.MAX_REGIONS
) -> Run:
    """Loss and gain regions of one difference plane (r, c, diff, valid), with the statistics that tell noise from change."""
    d = materialize(diff.withColumn("direction", E.direction("diff", "valid", threshold)), "detect")
    kept = materialize(R.sieved(d.where("direction is not null").select("direction", "r", "c"), sieve, width, height, ["direction"]), "pieces")
    whole = R.components(kept.select("direction", "r", "c"), width, height, True, ["direction"])
    capped = R.region_cap(R.sizes(whole, ["direction"]), limit)
    dropped = capped.agg(F.coalesce(F.max("dropped"), F.lit(0)).alias("dropped"))
    both = kept.withColumnRenamed("label", "piece").join(whole, ["direction", "r", "c"]).groupBy("direction", "label", "piece").agg(F.count(F.lit(1)).alias("pixels"))
    found = both.join(capped.select("direction", "label"), ["direction", "label"], "left_semi").withColumn("area_ha", E.hectares("pixels", pixel_area_m2))
    found = R.numbered(found, [F.desc("direction"), F.col("label"), F.col("piece")]).withColumn("id", F.col("number") - 1).drop("number")
    found = materialize(found, "features")
    trimmed = found.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("trimmed"))
    clear = d.agg(F.coalesce(F.avg(F.coalesce(F.col("valid"), F.lit(False)).cast("double")), F.lit(0.0)).alias("clear_fraction"))
    ha = lambda k: E.hectares(F.count_if(F.col("direction") == k), pixel_area_m2).alias(f"{k}_ha")
    stats = clear.crossJoin(F.broadcast(kept.agg(ha("loss"), ha("gain")))).crossJoin(F.broadcast(dropped)).crossJoin(F.broadcast(trimmed))
    stats = stats.withColumn("dropped", F.col("dropped") + F.col("trimmed")).drop("trimmed")
    total, less = F.col("loss_ha") + F.col("gain_ha"), F.least("loss_ha", "gain_ha")
    warn = F.array_compact(
        F.array(
            F.when(F.col("dropped") > 0, F.format_string("%d smaller regions are counted in the hectares but not listed", "dropped")),
            F.when(F.col("clear_fraction") < least_clear, F.format_string("only %.0f%% of the area was clear", F.col("clear_fraction") * 100)),
            F.when(F.coalesce(F.try_divide(less, total), F.lit(0.0)) > 0.4, F.lit("loss and gain are near-symmetric, as noise is")),
        )
    )
    return Run(d, R.trim(found, limit).drop("trimmed"), stats.withColumns({"total_ha": total, "warnings": warn}), [], kept)


def compare_flights(
    before: DataFrame, after: DataFrame, nir: bool, height: int, width: int, threshold: float, sieve: int, res: float, shift: tuple[int, int] | None = None
) -> Run:
    """Two drone flights (r, c, b1..b4) on one grid: NDVI with a near-infrared band, else VARI.

    The second is shifted back by ``shift``, or by the estimated shift where none is given; one beyond tolerance is not applied, and noted.
    """
    index = E.norm_diff("b4", "b1") if nir else E.vari("b2", "b1", "b3")
    notes = []
    a = before.select("r", "c", index.alias("a"))
    if shift is None:
        best = C.estimate_shift(a.withColumnRenamed("a", "v"), after.select("r", "c", index.alias("v")), "v", height, width).first()
        shift = (-best.dy, -best.dx) if best.within_tolerance else (0, 0)
        if not best.within_tolerance:
            notes.append(f"the flights lie {best.dy}, {best.dx} pixels apart, beyond tolerance: no shift is applied")
    b = G.roll(after, *shift, height, width).select("r", "c", index.alias("b"))
    diff = a.join(b, ["r", "c"]).select("r", "c", (F.col("b") - F.col("a")).alias("diff"))
    run = detect(diff.withColumn("valid", F.col("diff").isNotNull()), height, width, threshold, sieve, res * res)
    run.notes += notes
    return run


def timeline(used: DataFrame) -> DataFrame:
    return S.timeline(used).select("step", "date", "sensor", "id")


def until(regions: DataFrame, day: Column) -> DataFrame:
    """Regions shown at a date: undated ones and those changed by then."""
    return regions.where(F.col("change_date").isNull() | (F.col("change_date") <= day))


def smart(requests: DataFrame, gazetteer: DataFrame, span: float = 0.10) -> DataFrame:
    """Plain-language requests to place, area, index hint and prompt."""
    return S.resolve(requests, gazetteer, span).withColumn("prompt", E.build_prompt("what"))


def with_geometry(run: Run, left: float, top: float, res: float, epsg: int) -> DataFrame:
    """The run's features with their rings in WGS84."""
    keys = ["tier", "direction", "label"]
    ringed = R.in_degrees(R.rings(run.pieces, ["tier", "direction"]).drop("pixels"), keys, left, top, res, epsg).drop("rings")
    return run.regions.join(ringed.withColumnRenamed("label", "piece"), ["tier", "direction", "piece"])


def feature_collection(regions: DataFrame, columns: list[str]) -> DataFrame:
    """One GeoJSON feature per row as text lines; a sink writes them with ``write.text``."""
    return regions.select(R.to_feature(columns, F.col("geometry")).alias("value"))


def save_run(run: Run, path: str, columns: list[str], run_id: str, created: str) -> None:
    """Writes the features, then the status that points at them: a run is never done without its result."""
    run.regions.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(f"{path}/{run_id}.result")
    n = run.regions.count()
    meta = run.regions.sparkSession.createDataFrame([(run_id, created, "done", n)], "id string, created string, status string, feature_count long")
    meta.coalesce(1).write.mode("append").json(f"{path}/runs")


def load_result(runs: DataFrame, path: str, run_id: str) -> DataFrame:
    """A finished run's features; only ids of known runs that are done are looked up."""
    if runs.where((F.col("id") == run_id) & (F.col("status") == "done")).isEmpty():
        raise ValueError(f"no finished run {run_id!r}")
    return runs.sparkSession.read.json(f"{path}/{run_id}.result")
