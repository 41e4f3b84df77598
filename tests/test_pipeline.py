from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rasterflux.functions import grids as G
from rasterflux.operators import scenes as S
from rasterflux.plans import pipeline as P
from rasterflux.plans.params import Params, check_grid
from rasterflux.streaming.persistence import stream_persistence

SIDE = 20


def grid(spark):
    return spark.range(SIDE * SIDE).select(F.expr(f"cast(id div {SIDE} as int) r"), F.expr(f"cast(id % {SIDE} as int) c"))


def scene(spark, step, inside, outside=(0.6, 0.2, 0.1), ok=None):
    """NDVI, NDWI, NDBI of an 8 x 8 block and of the rest."""
    block = (F.col("r") < 8) & (F.col("c") < 8)
    names = ("ndvi", "ndwi", "ndbi")
    return grid(spark).select(
        "r", "c", F.lit(step).alias("step"), *[F.when(block, F.lit(a)).otherwise(F.lit(b)).alias(n) for n, a, b in zip(names, inside, outside, strict=True)], (F.lit(True) if ok is None else ok).alias("ok")
    )


def radar(spark, step, inside):
    return grid(spark).select("r", "c", F.lit(step).alias("step"), F.when((F.col("r") < 8) & (F.col("c") < 8), inside).otherwise(-12.0).alias("db"), F.lit(True).alias("ok"))


def test_pair(spark):
    o = scene(spark, 0, (0.6, 0.2, 0.1)).union(scene(spark, 1, (0.1, 0.2, 0.3)))
    s = radar(spark, 0, -12.0).union(radar(spark, 1, -6.0))
    run = P.run_pair(grid(spark), o, s, SIDE, SIDE, Params(sieve=10))
    (region,) = run.regions.collect()
    assert (region.tier, region.direction, region.pixels, region.change_type) == ("confirmed", "loss", 64, "construction")
    assert region.area_ha == pytest.approx(0.64) and region.sar_db_delta == 6.0 and region.ndvi_delta == -0.5
    stats = run.stats.first()
    assert stats.hectares["confirmed"] == 0.64 and stats.hectares["optical"] == 0 and stats.s2_usable == 100.0


def test_one_sensor_and_none(spark):
    o = scene(spark, 0, (0.6, 0.2, 0.1)).union(scene(spark, 1, (0.1, 0.2, 0.3)))
    run = P.run_pair(grid(spark), o, None, SIDE, SIDE, Params(sieve=10))
    (region,) = run.regions.collect()
    assert region.tier == "optical" and region.sar_db_delta is None and run.notes == [P.NO_RADAR]
    assert region.change_type == "vegetation_loss" and region.confidence == 0.5
    with pytest.raises(ValueError):
        P.run_pair(grid(spark), None, None, SIDE, SIDE, Params())


def used(spark, *rows):
    from datetime import date

    return spark.createDataFrame([(s, k, k, date.fromisoformat(day), i, o) for s, k, day, i, o in rows], P.USED)


def test_series(spark):
    o = scene(spark, 0, (0.6, 0.2, 0.1))
    for k in (1, 2, 3):
        o = o.union(scene(spark, k, (0.6, 0.2, 0.1) if k == 1 else (0.1, 0.2, 0.3)))
    s = radar(spark, 0, -12.0).union(radar(spark, 1, -12.0)).union(radar(spark, 2, -6.0)).union(radar(spark, 3, -6.0))
    days = [("S2", k, f"2024-0{k + 1}-05", 10 + k, None) for k in range(4)] + [("S1", k, f"2024-0{k + 1}-07", 20 + k, 5) for k in range(4)]
    run = P.run_series(grid(spark), o, s, SIDE, SIDE, Params(sieve=10), used(spark, *days))
    (region,) = run.regions.collect()
    assert (region.tier, str(region.change_date), region.dated_by, region.confirmed_by, region.persistence) == ("confirmed", "2024-03-05", "optical", 1, "confirmed")
    assert (region.scene_before, region.scene_after, region.sar_scene_before, region.sar_scene_after, region.relative_orbit) == (10, 12, 20, 23, 5)
    assert "NDVI -0.50" in region.evidence and "SAR +6.0 dB" in region.evidence
    stats = run.stats.first()
    assert (stats.persistent, stats.changed, stats.transient) == (64, 64, 0)


def test_series_starts_at_the_first_date_that_there_is(spark):
    o = scene(spark, 1, (0.6, 0.2, 0.1)).union(scene(spark, 2, (0.1, 0.2, 0.3))).union(scene(spark, 3, (0.1, 0.2, 0.3)))
    run = P.run_series(grid(spark), o, radar(spark, 2, -6.0), SIDE, SIDE, Params(sieve=10))
    (region,) = run.regions.collect()
    assert region.pixels == 64 and region.change_date is None
    assert run.notes == ["fewer than two usable radar dates", P.NO_RADAR]
    with pytest.raises(ValueError, match="two usable dates"):
        P.run_series(grid(spark), o.where("step = 1"), None, SIDE, SIDE, Params())


def test_radar_dates_where_optical_could_not_see(spark):
    o = scene(spark, 0, (0.6, 0.2, 0.1), ok=F.col("r") >= 8).union(scene(spark, 1, (0.1, 0.2, 0.3), ok=F.col("r") >= 8)).union(scene(spark, 2, (0.1, 0.2, 0.3), ok=F.col("r") >= 8))
    s = radar(spark, 0, -12.0).union(radar(spark, 1, -6.0)).union(radar(spark, 2, -6.0))
    days = [("S2", k, f"2024-0{k + 1}-05", 10 + k, None) for k in range(3)] + [("S1", k, f"2024-0{k + 1}-07", 20 + k, None) for k in range(3)]
    (region,) = P.run_series(grid(spark), o, s, SIDE, SIDE, Params(sieve=10), used(spark, *days)).regions.collect()
    assert (region.tier, region.dated_by, str(region.change_date), region.confirmed_by) == ("sar_gap", "radar", "2024-02-07", 1)
    assert (region.scene_after, region.sar_scene_after, region.ndvi_delta) == (12, 21, None)


def test_never_imaged_and_cloud(spark):
    hidden = scene(spark, 0, (0.6, 0.2, 0.1), ok=F.col("r") >= 10).union(scene(spark, 1, (0.6, 0.2, 0.1)))
    hidden = hidden.withColumn("never", F.col("r") < 5)
    s = radar(spark, 0, -12.0).union(radar(spark, 1, -12.0))
    stats = P.run_pair(grid(spark), hidden, s, SIDE, SIDE, Params()).stats.first()
    assert (stats.optical_gap, stats.never_imaged, stats.cloud_gap) == (50.0, 25.0, 25.0) and any("footprint" in w for w in stats.warnings)
    stats = P.run_series(grid(spark), hidden, s, SIDE, SIDE, Params()).stats.first()
    assert (stats.optical_gap, stats.never_imaged) == (50.0, 25.0)


def test_features_are_pieces_and_the_largest_are_listed(spark):
    # Two blocks that meet at a corner are one region of two features; a third lies apart.
    hit = F.expr("(r < 4 and c < 4) or (r between 4 and 8 and c between 4 and 8) or (r > 14 and c > 16)")
    d = grid(spark).select("r", "c", F.when(hit, -0.5).otherwise(0.0).alias("diff"), F.lit(True).alias("valid"))
    run = P.detect(d, SIDE, SIDE, 0.2, 4)
    assert [(r.label, r.piece, r.pixels) for r in run.regions.orderBy("id").collect()] == [(0, 0, 16), (0, 84, 25), (317, 317, 15)]
    few = P.detect(d, SIDE, SIDE, 0.2, 4, limit=1)
    assert [r.pixels for r in few.regions.collect()] == [25]
    stats = few.stats.first()
    assert stats.dropped == 2 and stats.loss_ha == pytest.approx(0.56) and "2 smaller regions" in stats.warnings[0]


def test_runs_are_saved_and_loaded(spark, tmp_path):
    from rasterflux.sources import tables as T

    o = scene(spark, 0, (0.6, 0.2, 0.1)).union(scene(spark, 1, (0.1, 0.2, 0.3)))
    run = P.run_pair(grid(spark), o, None, SIDE, SIDE, Params(sieve=10))
    P.save_run(run, str(tmp_path), ["id", "tier", "pixels"], "abc", "2024-01-01")
    runs = T.load_runs(spark, f"{tmp_path}/runs")
    assert [(r.id, r.status, r.feature_count) for r in runs.collect()] == [("abc", "done", 1)]
    assert P.load_result(runs, str(tmp_path), "abc").first().pixels == 64
    with pytest.raises(ValueError):
        P.load_result(runs, str(tmp_path), "../abc")
    geometry = P.with_geometry(run, 500_000.0, 1_000_000.0, 10.0, 32643).first()
    assert len(geometry.coordinates) == 1 and len(geometry.coordinates[0]) == 5


def test_scene_lookups(spark):
    sc = spark.createDataFrame([(1, "S1", 3), (2, "S1", 4)], "id long, sensor string, relative_orbit int").withColumn("date", F.lit("2024-01-01").cast("date"))
    assert S.scene_by_id(sc, "2").count() == 1
    for bad in ("../2", "", "a?b", None):
        with pytest.raises(ValueError):
            S.scene_by_id(sc, bad)
    with pytest.raises(Exception, match="no shared relative orbit"):
        S.orbit_pair(sc.where("id = 1"), sc.where("id = 2")).collect()
    found, notes = S.listing(None, sc.withColumns({k: F.lit(0.0) for k in ("west", "south", "east", "north")}), "2024-01-01", "2024-01-02")
    assert found.count() == 2 and notes == ["S2 search failed"]


def test_queue(spark):
    runs = spark.createDataFrame([(f"r{k}", f"2024-01-0{k + 1}", "done" if k < 3 else "pending") for k in range(6)], "id string, created string, status string")
    assert sorted(r.id for r in S.submit(runs, "new", "2024-02-01", keep=2).collect()) == ["new", "r1", "r2", "r3", "r4", "r5"]
    with pytest.raises(RuntimeError):
        S.submit(runs, "new", "2024-02-01", waiting=3)
    shown = {r.job_id: r for r in S.run_status(runs.withColumns({"feature_count": F.lit(7), "error": F.lit("")})).collect()}
    assert shown["r0"].feature_count == 7 and shown["r4"].feature_count is None and shown["r0"].error is None


def test_encoder_hook(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0])], "id int, crop array<double>")
    assert S.embed(df, lambda batch: batch).first().embedding == pytest.approx([0.6, 0.8])


def test_detect_and_warnings(spark):
    d = grid(spark).select("r", "c", F.when(F.col("r") < 4, -0.5).when(F.col("r") > 15, 0.5).otherwise(0.0).alias("diff"), (F.col("c") < 8).alias("valid"))
    run = P.detect(d, SIDE, SIDE, 0.2, 10)
    assert sorted((r.direction, r.pixels) for r in run.regions.collect()) == [("gain", 32), ("loss", 32)]
    assert len(run.stats.first().warnings) == 2
    nothing = P.detect(d.withColumn("valid", F.lit(False)), SIDE, SIDE, 0.2, 10)
    assert nothing.regions.count() == 0 and nothing.stats.first().clear_fraction == 0


def test_flights(spark):
    g = grid(spark).select("r", "c", F.lit(0.2).alias("b1"), F.lit(0.3).alias("b2"), F.lit(0.1).alias("b3"), F.lit(0.6).alias("b4"))
    cut = g.withColumn("b4", F.when((F.col("r") < 5) & (F.col("c") < 5), 0.2).otherwise(F.col("b4")))
    (region,) = P.compare_flights(g, cut, True, SIDE, SIDE, 0.2, 4, 0.05).regions.collect()
    assert region.direction == "loss" and region.area_ha == pytest.approx(25 * 0.0025 / 1e4)


@pytest.mark.parametrize("bad", [{"steps": 1}, {"sieve": -1}, {"index": "x"}, {"pol": "hh"}, {"top_k": 0}, {"start": "2025-01-01"}])
def test_bounds(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_defaults_and_grid():
    assert Params(optical_threshold=0).optical_threshold == 0.20 and Params(sieve=0).sieve == 0
    with pytest.raises(ValueError):
        check_grid(4000, 4000)


def test_boxes(spark):
    df = spark.sql("select array(array(array(1D, 2D), array(1.5D, 2D), array(1.5D, 2.2D), array(1D, 2D))) g").select(G.ring_bounds(F.col("g")).alias("b"))
    row = df.select("b.*", G.size_label(F.col("b")).alias("label"), G.crop_box(F.col("b")).alias("crop")).first()
    assert (row.west, row.south, row.east, row.north) == (1.0, 2.0, 1.5, 2.2) and row.label == "55.5 x 22.2 km"
    assert row.crop["east"] - row.crop["west"] == pytest.approx(0.8)
    a = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 0.1)], "left double, bottom double, right double, top double, res double")
    b = spark.createDataFrame([(5.0, 5.0, 20.0, 20.0, 0.05)], a.schema)
    row = G.common_grid(a, b).first()
    assert (row.width, row.height, row.res) == (100, 100, 0.05)


def test_ranking_and_matches(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.8, 0.6])], "vec_id int, embedding array<float>")
    top = S.rank_by_vector(df, [1.0, 0.0], 2)
    assert [(r.feature_index, r["rank"]) for r in top.orderBy("rank").collect()] == [(0, 1), (2, 2)]
    assert S.rank_by_vector(df, [1.0, 0.0], 0).count() == 1
    marked = S.mark_matches(df.withColumnRenamed("vec_id", "feature_index"), top)
    assert marked.where("match_rank is null").count() == 1


def test_stream(spark, tmp_path):
    rows = [(0, 0, 0, -0.4), (0, 0, 1, -0.5), (0, 1, 0, -0.4), (0, 1, 1, 0.0)]
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[2] == k], "r int, c int, t int, diff double").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    source = spark.readStream.schema("r int, c int, t int, diff double").parquet(str(tmp_path / "in*"))
    query = (
        stream_persistence(source, 0.2).writeStream.outputMode("update").format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.processAllAvailable()
    query.stop()
    last = {(r.r, r.c): r for r in spark.sql("select * from verdicts").orderBy("n").collect()}
    assert last[0, 0].persistent and last[0, 0].change_index == 0 and not last[0, 1].persistent
