"""Raster files, catalogues on files, warps and joins of boxes, against what the tests write and brute force."""

from __future__ import annotations

import datetime
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflux.operators import spatial
from rasterflux.operators import warp as WP
from rasterflux.sources import items, tiff


def write_tiff(path, planes, order="<", tile=None, strip=7, deflate=True, predictor=1, planar=False, big=False, extra=()):
    """A TIFF file by the book: planes is bands x rows x columns."""
    bands, height, width = planes.shape
    dtype = planes.dtype.newbyteorder(order)
    bh, bw = tile or (strip, width)
    blocks = []
    for group in [[b] for b in range(bands)] if planar else [list(range(bands))]:
        for top in range(0, height, bh):
            for left in range(0, width, bw):
                rows = bh if tile else min(bh, height - top)
                block = np.zeros((rows, bw, len(group)), planes.dtype)
                cut = planes[group, top : top + rows, left : left + bw].transpose(1, 2, 0)
                block[: cut.shape[0], : cut.shape[1]] = cut
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((rows, 1, len(group)), planes.dtype)).astype(planes.dtype)
                data = block.astype(dtype).tobytes()
                if predictor == 3:
                    size = dtype.itemsize
                    lines = np.frombuffer(block.astype(planes.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(rows, bw * len(group), size).transpose(0, 2, 1).reshape(rows, -1).astype(int)
                    step = len(group)
                    moved = lines.copy()
                    moved[:, step:] -= lines[:, :-step]
                    data = (moved % 256).astype(np.uint8).tobytes()
                blocks.append(zlib.compress(data) if deflate else data)
    kind = {"u": 1, "i": 2, "f": 3}[planes.dtype.kind]
    word = "Q" if big else "I"
    head = 16 if big else 8
    places, at = [], head
    for b in blocks:
        places.append(at)
        at += len(b)
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [dtype.itemsize * 8] * bands), (259, "H", [8 if deflate else 1]), (277, "H", [bands]), (284, "H", [2 if planar else 1]), (317, "H", [predictor]), (339, "H", [kind] * bands)]
    sizes = [len(b) for b in blocks]
    tags += [(322, "I", [bw]), (323, "I", [bh]), (324, word, places), (325, "I", sizes)] if tile else [(273, word, places), (278, "I", [bh]), (279, "I", sizes)]
    tags = sorted([*tags, *extra])
    codes = {"H": 3, "I": 4, "d": 12, "Q": 16, "s": 2}
    entry, count = (20, 8) if big else (12, 2)
    after = at + count + entry * len(tags) + (8 if big else 4)
    out, tail = b"", b""
    for tag, code, values in tags:
        data = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        room = 8 if big else 4
        place = data.ljust(room, b"\0") if len(data) <= room else struct.pack(order + word, after + len(tail))
        out += struct.pack(order + "HH" + word, tag, codes[code], len(values)) + place
        tail += data if len(data) > room else b""
    first = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    path.write_bytes(first + b"".join(blocks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + out + struct.pack(order + word, 0) + tail)


LAYOUTS = [
    {"dtype": "u2", "tile": (16, 32)},
    {"dtype": "u1", "strip": 7, "predictor": 2},
    {"dtype": "i2", "order": ">", "strip": 50, "deflate": False},
    {"dtype": "i4", "order": ">", "tile": (16, 16), "predictor": 2, "planar": True},
    {"dtype": "f4", "tile": (32, 16), "predictor": 3},
    {"dtype": "f8", "tile": (16, 16), "predictor": 3, "big": True},
    {"dtype": "f8", "order": ">", "strip": 9, "big": True, "planar": True},
    {"dtype": "u4", "strip": 1 << 20, "deflate": False, "planar": True},
]


@pytest.mark.parametrize("layout", LAYOUTS, ids=str)
def test_files_are_read_pixel_for_pixel(spark, tmp_path, layout):
    layout = dict(layout)
    dtype = np.dtype(layout.pop("dtype"))
    rng = np.random.default_rng(4)
    planes = rng.normal(size=(3, 45, 37)).astype(dtype) if dtype.kind == "f" else rng.integers(0, 250, (3, 45, 37)).astype(dtype)
    planes[0, 3, 4] = 77
    write_tiff(tmp_path / "a.tif", planes, extra=[(42113, "s", b"77\0")], **layout)
    whole = tiff.read(spark, str(tmp_path), tiles=2).toPandas()
    assert len(whole) == 45 * 37 and list(whole.columns) == ["path", "r", "c", "b1", "b2", "b3"]
    for b in range(3):
        got = np.full((45, 37), np.nan)
        got[whole.r, whole.c] = whole[f"b{b + 1}"]
        want = planes[b].astype(float)
        np.testing.assert_array_equal(got, np.where(want == 77, np.nan, want))
    cut = tiff.read(spark, str(tmp_path / "a.tif"), bands=[3, 1], window=(10, 30, 18, 99)).orderBy("r", "c").collect()
    assert [(x.r, x.c) for x in cut] == [(r, c) for r in range(10, 18) for c in range(30, 37)]
    assert all(x.b3 == planes[2, x.r, x.c] or planes[2, x.r, x.c] == 77 for x in cut)


def test_what_is_not_decoded_raises(tmp_path):
    write_tiff(tmp_path / "a.tif", np.ones((1, 4, 4), "u1"), deflate=False)
    raw = bytearray((tmp_path / "a.tif").read_bytes())
    at = raw.index(struct.pack("<HH", 259, 3))
    raw[at + 8] = 5
    (tmp_path / "lzw.tif").write_bytes(raw)
    with pytest.raises(ValueError, match="compression 5"):
        tiff.directory(str(tmp_path / "lzw.tif"))
    (tmp_path / "text.tif").write_bytes(b"no raster at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.directory(str(tmp_path / "text.tif"))


def test_a_small_window_plans_only_its_tiles(tmp_path):
    write_tiff(tmp_path / "a.tif", np.zeros((1, 640, 640), "u1"), tile=(64, 64))
    reader = tiff.RasterReader({"path": str(tmp_path / "a.tif"), "tiles": "1"})
    assert len(reader.partitions()) == 100
    left = list(reader.narrow([tiff.GreaterThanOrEqual(("r",), 100), tiff.LessThan(("r",), 129), tiff.EqualTo(("c",), 5), tiff.EqualTo(("b1",), 0.0)]))
    assert [x.attribute for x in left] == [("b1",)]
    assert sorted(b for p in reader.partitions() for b in p.blocks) == [10, 20]
    outside = tiff.RasterReader({"path": str(tmp_path / "a.tif"), "window": "700,0,800,10"})
    assert outside.partitions() == [None]


def test_conditions_are_pushed_down(spark, tmp_path):
    write_tiff(tmp_path / "a.tif", np.arange(64 * 64, dtype="u2").reshape(1, 64, 64), tile=(16, 16))
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        df = tiff.read(spark, str(tmp_path / "a.tif"), tiles=1).where("r >= 20 and r < 30 and c = 40")
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Nothing is left for Spark to filter but nulls.
        assert "20" not in plan and df.rdd.getNumPartitions() == 1
        assert sorted(x.b1 for x in df.collect()) == [r * 64 + 40 for r in range(20, 30)]
    finally:
        spark.conf.unset(name)


def test_written_rasters_keep_their_place(spark, tmp_path):
    px = spark.range(50 * 70).select(F.expr("cast(id div 70 as int) r"), F.expr("cast(id % 70 as int) c"), (F.col("id") / 7).alias("a"), F.col("id").cast("int").alias("b")).where("id % 5 <> 0 and not (r < 16 and c < 16)")
    paths = tiff.write(px, str(tmp_path / "out"), F.concat(F.lit("k"), F.col("b") % 2), ["a", "b"], 50, 70, 16, (1000.0, 2000.0), (10.0, 20.0), 32643)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["k0.tif", "k1.tif"] and sorted(x.name for x in (tmp_path / "out").iterdir()) == ["k0.tif", "k1.tif"]
    head = tiff.directory(paths[0])
    assert (head.origin, head.pixel, head.epsg, head.bands, head.width, head.height) == ((1000.0, 2000.0), (10.0, 20.0), 32643, 2, 70, 50)
    got = sorted((x.r, x.c, x.b1, int(x.b2)) for x in tiff.read(spark, paths).where("b2 is not null").collect())
    assert got == sorted(tuple(x) for x in px.collect())


def scenes(spark, n=500):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        w, s = rng.uniform(-180, 178), rng.uniform(-90, 88)
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(200))
        rows.append((f"s{i:04d}", rng.choice(["S1", "S2"]), day, None if i % 3 == 0 else rng.uniform(0, 100), rng.randrange(12), "ascending", w, s, w + rng.uniform(0, 2), s + rng.uniform(0, 2)))
    return spark.createDataFrame(rows, items.SCHEMA)


def test_catalogue_prunes_files_and_items(spark, tmp_path):
    df = scenes(spark)
    folder = str(tmp_path / "catalogue")
    files = items.write(df, folder, 25)
    assert files >= 20
    everything = items.read(spark, folder)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, df.collect()))
    found = items.search(spark, folder, "S2", "2024-03-01", "2024-03-31", 60.0, (-60.0, -45.0, 90.0, 45.0))
    want = df.where("sensor = 'S2' and date between date'2024-03-01' and date'2024-03-31' and cloud_cover < 60 and west <= 90 and east >= -60 and south <= 45 and north >= -45")
    assert want.count() > 0 and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.rdd.getNumPartitions() < files / 2
    with pytest.raises(ValueError, match="not a condition"):
        items.read(spark, folder, [("colour", "=", "red")])


def test_small_catalogue_files_share_partitions(spark, tmp_path, monkeypatch):
    df = scenes(spark)
    folder = str(tmp_path / "catalogue")
    files = items.write(df, folder, 10)
    monkeypatch.setattr(items, "ITEMS", 100)
    reader = items.ItemReader({"path": folder})
    parts = reader.partitions()
    assert len(parts) < files / 4 and len({p for x in parts for p in x.paths}) == sum(len(x.paths) for x in parts) == files
    assert sum(b.num_rows for x in parts for b in reader.read(x)) == df.count()
    assert max(sum(b.num_rows for b in reader.read(x)) for x in parts) <= 100


def test_catalogue_takes_the_conditions_of_the_plan(spark, tmp_path):
    df = scenes(spark)
    folder = str(tmp_path / "catalogue")
    files = items.write(df, folder, 25)
    name = "spark.sql.python.filterPushdown.enabled"
    where = "date >= date'2024-02-01' and date < date'2024-02-20' and sensor = 'S1' and id in ('s0003', 's0010', 's0100', 's0150', 's0200') and relative_orbit + 1 > 3"
    spark.conf.set(name, "true")
    try:
        found = items.read(spark, folder).where(where)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "2024-02" not in plan and "s0003" not in plan and "relative_orbit" in plan
        assert found.rdd.getNumPartitions() < files / 4
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.where(where).collect()))
    finally:
        spark.conf.unset(name)


def test_areas_meet_scenes_once(spark):
    rng = random.Random(9)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    box = lambda most: (w := rng.uniform(-180, 180 - most), s := rng.uniform(-90, 90 - most), w + rng.uniform(0, most), s + rng.uniform(0, most))
    areas = [(i, *box(rng.choice([0.01, 2, 50, 170])), day(a := rng.randrange(300)), day(a + rng.randrange(120))) for i in range(60)]
    scenes = [(i, *box(rng.choice([0.5, 3, 60])), day(rng.randrange(365))) for i in range(600)]
    # Touching edges, points, the whole globe, boxes out of order, nulls.
    areas += [(100, 0.0, 0.0, 10.0, 10.0, day(0), day(400)), (101, -180.0, -90.0, 180.0, 90.0, day(10), day(10)), (102, 5.0, 5.0, 4.0, 6.0, day(0), day(400)), (103, 0.0, 0.0, 1.0, 1.0, None, day(4)), (104, 0.0, 0.0, 1.0, 1.0, day(9), day(4))]
    scenes += [(1000, 10.0, 10.0, 11.0, 11.0, day(3)), (1001, 5.0, 5.0, 5.0, 5.0, day(3)), (1002, None, 5.0, 5.0, 5.0, day(3)), (1003, 1.0, 1.0, 2.0, 2.0, None), (1004, -180.0, -90.0, 180.0, 90.0, day(10))]
    a = spark.createDataFrame(areas, "id int, west double, south double, east double, north double, start date, end date")
    s = spark.createDataFrame(scenes, "id int, west double, south double, east double, north double, date date")
    found = spatial.join(a, s)
    got = sorted((r.a_id, r.s_id) for r in found.collect())
    sound = lambda x: x[1] is not None and x[1] <= x[3] and x[2] <= x[4]
    want = sorted(
        (x[0], y[0]) for x in areas for y in scenes
        if sound(x) and sound(y) and y[5] and x[5] and x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4] and x[5] <= y[5] <= x[6]
    )
    assert len(want) > 100 and got == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def brute_warp(plane, place, side, nearest):
    out = {}
    for r in range(side):
        for c in range(side):
            y, x = place(r, c)
            if nearest:
                v = plane.get((math.floor(y + 0.5), math.floor(x + 0.5)))
                if v is not None:
                    out[r, c] = v
                continue
            i, j = math.floor(y), math.floor(x)
            near = [(plane.get((i + a, j + b)), (y - i if a else 1 - y + i) * (x - j if b else 1 - x + j)) for a in (0, 1) for b in (0, 1)]
            near = [(v, w) for v, w in near if v is not None and w > 0]
            if near:
                out[r, c] = sum(v * w for v, w in near) / sum(w for _, w in near)
    return out


@pytest.mark.parametrize("nearest", [False, True])
@pytest.mark.parametrize("parts", [1, 3])
def test_warp_across_blocks(spark, nearest, parts):
    """A grid of several blocks, with holes, under a rotation that leaves it on all sides."""
    rng = random.Random(6)
    plane = {(r, c): float(rng.randrange(1000)) for r in range(240, 300) for c in range(250, 300) if rng.random() < 0.9}
    plane |= {(0, 0): 5.0, (-1, 3): 6.0}
    rows = [(r, c, v) for (r, c), v in plane.items()] + [(260, 400, float("nan")), (261, 400, None)]
    source = spark.createDataFrame(rows, "r int, c int, v double")
    target = spark.range(80 * 80).select(F.expr("cast(id div 80 as int) r"), F.expr("cast(id % 80 as int) c"))
    turn = (235.0, 0.9, 0.35, 262.0, -0.33, 0.85)
    got = {(x.r, x.c): x.v for x in WP.warp(source, target, "v", WP.affine(*turn), nearest, parts).collect()}
    want = brute_warp(plane, lambda r, c: (turn[0] + turn[1] * (r + 0.5) + turn[2] * (c + 0.5), turn[3] + turn[4] * (r + 0.5) + turn[5] * (c + 0.5)), 80, nearest)
    assert len(want) > 1000 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert WP.parts_for(1.0) == 1 and WP.parts_for(10.0) == 7
