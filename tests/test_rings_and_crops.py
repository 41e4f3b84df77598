"""Rings by list ranking, chains of small patches, crops and their encoder, against brute force."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflux.operators import crops as K
from rasterflux.operators import regions as R
from rasterflux.operators import ring_links as L


def spiral(n):
    """A path one pixel wide that winds inwards with gaps of one pixel."""
    on, r, c, dr, dc = {(0, 0)}, 0, 0, 0, 1
    while True:
        for _ in range(2):
            a, b = r + dr, c + dc
            beyond = (a + dr, b + dc)
            if 0 <= a < n and 0 <= b < n and (a, b) not in on and beyond not in on:
                break
            dr, dc = dc, -dr
        else:
            return on
        r, c = a, b
        on.add((r, c))


def brute_rings(pixels):
    """Rings of one label as lists of corners, each from its least corner."""
    edges = []
    for r, c in pixels:
        for (dr, dc), a, b in (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))):
            if (r + dr, c + dc) not in pixels:
                edges.append((r + a[0], c + a[1], r + b[0], c + b[1]))
    return sorted(tuple(x[:-1]) for x in R._rings(edges))


def linked(spark, masks, width, height):
    rows = [(k, r, c) for k, m in masks.items() for r, c in m]
    lab = R.components(spark.createDataFrame(rows, "k string, r int, c int"), width, height, eight=False, keys=["k"], tile=16)
    lab = lab.persist()
    out = {}
    for x in L.ring_corners(lab, ["k"], width).orderBy("k", "label", "ring", "position").collect():
        out.setdefault((x.k, x.label, x.ring, x.outer, x.parent), []).append((x.r, x.c))
    pixels = {}
    for x in lab.collect():
        pixels.setdefault((x.k, x.label), set()).add((x.r, x.c))
    return out, pixels


def rotated(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


def test_rings_of_a_spiral_and_of_noise(spark):
    rng = random.Random(3)
    noise = {(r, c) for r in range(30) for c in range(30) if rng.random() < 0.6}
    frame = {(r, c) for r in range(20) for c in range(20) if not (3 <= r < 17 and 3 <= c < 17) or (6 <= r < 14 and 6 <= c < 14 and not 9 <= r < 11)}
    out, pixels = linked(spark, {"spiral": spiral(40), "noise": noise, "frame": frame, "pixel": {(39, 39)}}, 40, 40)
    got, want = {}, {}
    for (k, label, ring, outer, parent), corners in out.items():
        assert corners == list(rotated(corners)) and (parent is None) == outer
        got.setdefault((k, label), []).append(rotated(corners))
    for key, px in pixels.items():
        want[key] = [rotated(list(x)) for x in brute_rings(px)]
    assert got.keys() == want.keys() and all(sorted(got[k]) == sorted(want[k]) for k in want)
    # One outer ring a label, which its holes name.
    for key in pixels:
        outer = [ring for (k, label, ring, o, _) in out if (k, label) == key and o]
        assert len(outer) == 1 and {p for (k, label, _, o, p) in out if (k, label) == key and not o} <= set(outer)
    assert len([1 for k in out if k[0] == "spiral"]) == 1 and len(spiral(40)) > 600


def test_chains_of_nested_rings_take_few_rounds(spark, monkeypatch):
    """A column of patches, each larger than the one before, ends at a large one: sixty-four hops."""
    n = 64
    chain = spark.createDataFrame([(k % 2, k, (k + 1) % 2, k + 1, 1 if k < n - 1 else 99) for k in range(n)] + [(0, 900, 1, 901, 2), (1, 901, 0, 900, 2), (0, 950, None, None, None)], "on int, label long, to_on int, to long, to_n long")
    rounds = []
    write = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    got = {(r.on, r.label): r.new for r in R.resolved(chain, 50).collect()}
    assert got == {(k % 2, k): n % 2 for k in range(n)} and rounds.count("chain") <= 9


@pytest.mark.parametrize("tile", [16, 64])
def test_crops_are_slices_of_the_chip(spark, tile):
    rng = np.random.default_rng(1)
    chip = rng.integers(0, 256, (50, 70, 3))
    rows = [(r, c, *map(int, chip[r, c])) for r in range(50) for c in range(70) if (r, c) != (10, 10)]
    chip[10, 10] = 0
    px = spark.createDataFrame(rows, "r int, c int, red int, green int, blue int")
    boxes = [(1, 0, 0, 70, 50), (2, 5, 7, 6, 8), (3, 60, 40, 90, 60), (4, 15, 15, 33, 17), (5, 8, 8, 8, 20), (6, 200, 200, 210, 205)]
    found = {r.feature_index: np.frombuffer(r.crop, np.uint8).reshape(r.height, r.width, 3) for r in K.crops(spark.createDataFrame(boxes, "feature_index long, x0 int, y0 int, x1 int, y1 int"), px, ["red", "green", "blue"], tile=tile).collect()}
    wide = np.zeros((300, 300, 3))
    wide[:50, :70] = chip
    assert found.keys() == {b[0] for b in boxes}
    for i, x0, y0, x1, y1 in boxes:
        np.testing.assert_array_equal(found[i], wide[y0:y1, x0:x1])


def test_the_encoder_loads_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def encode(images):
            assert len(images) <= 32
            return [np.array([x[..., 0].sum() + 1.0, x[..., 1].sum(), len(images)]) for x in images]

        return encode

    rows = [(i, 2, 3, bytes([i % 256]) * 18) for i in range(300)] + [(300, 0, 3, b"")]
    df = spark.createDataFrame(rows, "feature_index long, height int, width int, crop binary").repartition(12)
    for _ in range(2):
        got = {r.feature_index: r.embedding for r in K.embed_crops(df, "sums", load).collect()}
    assert got[300] is None and all(abs(np.linalg.norm(v) - 1) < 1e-5 for k, v in got.items() if k < 300)
    loads = open(log).read().split()
    assert 0 < len(loads) == len(set(loads))
