from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rasterflux.functions import exprs as E


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("out")).first()["out"]


def test_norm_diff_and_zero_denominator(spark):
    assert one(spark, E.norm_diff("nir", "red"), nir=0.6, red=0.2) == pytest.approx(0.5)
    assert one(spark, E.norm_diff("a", "b"), a=0.0, b=0.0) == 0.0
    with pytest.raises(ValueError):
        E.named_index("nope")


@pytest.mark.parametrize(("scl", "ok"), [(2, True), (4, True), (7, True), (3, False), (8, False), (0, False)])
def test_scl(spark, scl, ok):
    assert one(spark, E.scl_valid("s"), s=scl) is ok


@pytest.mark.parametrize(("g", "db"), [(1.0, 0.0), (0.1, -10.0), (0.0, None), (-1.0, None), (float("nan"), None), (float("inf"), None)])
def test_to_db(spark, g, db):
    got = one(spark, E.to_db("g"), g=g)
    assert got is None if db is None else got == pytest.approx(db)


@pytest.mark.parametrize(
    ("d2", "d1", "v2", "v1", "tier"),
    [
        (-0.5, -6.0, True, True, "confirmed"),
        (-0.5, 0.0, True, True, "optical"),
        (0.0, -6.0, True, True, "sar_only"),
        (0.0, -6.0, False, True, "sar_gap"),
        (-0.5, 0.0, True, False, "optical"),
        (0.0, 0.0, True, True, None),
        (-0.1, -1.0, True, True, None),
    ],
)
def test_tiers(spark, d2, d1, v2, v1, tier):
    assert one(spark, E.tier("d2", "v2", "d1", "v1"), d2=d2, v2=v2, d1=d1, v1=v1) == tier


def test_direction_needs_a_positive_threshold(spark):
    with pytest.raises(ValueError):
        E.direction("d", "v", 0)
    assert one(spark, E.direction("d", "v", 0.2), d=-0.2, v=True) == "loss"
    assert one(spark, E.direction("d", "v", 0.2), d=0.9, v=False) is None


@pytest.mark.parametrize(
    ("ndvi", "ndwi", "ndbi", "db", "elongation", "opt", "sar", "kind"),
    [
        (-0.4, 0.0, 0.12, 3.0, 1.0, True, True, "construction"),
        (-0.4, 0.0, 0.12, -4.0, 1.0, True, True, "clearance"),
        (-0.4, 0.0, 0.0, 0.0, 1.0, True, False, "vegetation_loss"),
        (0.0, 0.3, 0.0, -5.0, 1.0, True, True, "flooding"),
        (0.0, 0.0, 0.0, -5.0, 1.0, False, True, "flooding"),
        (0.0, -0.3, 0.0, 0.0, 1.0, True, True, "water_recession"),
        (0.3, 0.0, 0.0, 0.0, 1.0, True, True, "vegetation_growth"),
        (0.0, 0.0, 0.0, 0.0, 5.0, False, True, "road_development"),
        (0.0, 0.0, 0.2, 0.0, 1.0, True, True, "surface_change"),
        (0.0, 0.0, -0.1, 4.0, 1.0, True, True, "structural_change"),
        (0.0, 0.0, 0.0, 0.0, 1.0, True, True, "other"),
    ],
)
def test_classify(spark, ndvi, ndwi, ndbi, db, elongation, opt, sar, kind):
    got = one(spark, E.classify(), ndvi=ndvi, ndwi=ndwi, ndbi=ndbi, sar_db=db, elongation=elongation, has_optical=opt, has_sar=sar)
    assert got["change_type"] == kind


@pytest.mark.parametrize(
    ("text", "what", "where"),
    [
        ("new construction near the gomti river", "new construction", "gomti river"),
        ("flooding in lakes in Kerala", "flooding in lakes", "Kerala"),
        ("Lucknow", "", "Lucknow"),
        ("houses next to  a lake", "houses", "lake"),
        ("construction near", "", "construction near"),
    ],
)
def test_split_request(spark, text, what, where):
    a, b = E.split_request("t")
    assert one(spark, F.struct(a, b), t=text)[:] == (what, where)


def test_aoi_window(spark):
    box = one(spark, E.aoi("la", "lo", "w", "s", "e", "n"), la=60.0, lo=10.0, w=8.0, s=58.0, e=12.0, n=62.0)
    assert box["windowed"] and box["east"] - box["west"] == pytest.approx(0.2, abs=1e-4)
    box = one(spark, E.aoi("la", "lo", "w", "s", "e", "n"), la=0.0, lo=10.0, w=9.96, s=-0.04, e=10.04, n=0.04)
    assert not box["windowed"] and box["west"] == 9.96


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(81.0, 26.85), (75.3, -12.0), (-179.9, 60.0)], "lon double, lat double").withColumn("epsg", E.utm_epsg("lon", "lat"))
    e, n = E.utm_forward("lon", "lat", "epsg")
    df = df.withColumns({"e": e, "n": n})
    lon, lat = E.utm_inverse("e", "n", "epsg")
    for row in df.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert math.isclose(row.lon, row.lon2, abs_tol=1e-8) and math.isclose(row.lat, row.lat2, abs_tol=1e-8)
        assert 100_000 < row.e < 900_000
    # On its central meridian a point has easting 500 000, and 81 E is that of zone 44.
    assert df.first()["e"] == pytest.approx(500_000, abs=1e-6)


def test_small_strings(spark):
    assert one(spark, E.public_error("m"), m="see https://x.org/a?key=1 now") == "see https://x.org/a?… now"
    assert one(spark, E.place_label("m"), m="a, b, c, d") == "a, b, c"
    assert one(spark, E.format_hectares("h"), h=123.4) == "123"
    assert one(spark, E.build_prompt("q"), q="a road") == "a road"
    assert one(spark, E.build_prompt("q"), q="roads") == "a satellite image of roads"
    assert one(spark, E.parse_bbox("b"), b="1,2,3,4") == [1.0, 2.0, 3.0, 4.0]
    assert one(spark, E.parse_bbox("b"), b="3,2,1,4") is None
