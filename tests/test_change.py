from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflux.operators import change as C
from rasterflux.operators import regions as R


def series(spark, rows):
    return spark.createDataFrame([(0, 0, t, d, v) for t, (d, v) in enumerate(rows)], "r int, c int, t int, diff double, valid boolean")


@pytest.mark.parametrize(
    ("rows", "min_persist", "persistent", "latest", "transient"),
    [
        ([(-0.4, True), (-0.42, True)], 1, True, False, False),
        ([(-0.4, True), (-0.42, True)], 2, False, True, False),
        ([(0.0, True), (-0.4, True)], 1, False, True, False),
        ([(-0.4, True), (0.0, True)], 1, False, False, True),
        ([(-0.4, True), (None, False), (-0.44, True)], 1, True, False, False),
        ([(0.0, True), (0.1, True)], 1, False, False, False),
    ],
)
def test_persistence_cases(spark, rows, min_persist, persistent, latest, transient):
    got = C.persistence(series(spark, rows), 0.2, min_persist).first()
    assert (got.persistent, got.latest, got.transient) == (persistent, latest, transient)


def test_persistence_against_the_rule(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for p in range(300):
        stack = [(rng.choice([-0.5, -0.1, 0.0, 0.5]), rng.random() < 0.8) for _ in range(4)]
        rows += [(p, 0, t, d, v) for t, (d, v) in enumerate(stack)]
        found = (-1, 0, False, False)
        for i, (d, v) in enumerate(stack):
            if not (v and abs(d) >= 0.2):
                continue
            later = [x for x, ok in stack[i + 1 :] if ok]
            agree = sum(abs(x) >= 0.2 and (x > 0) == (d > 0) for x in later)
            if later and agree == len(later):
                found = (i, agree, True, False)
                break
            if not later:
                found = (i, 0, False, True)
                break
        want[p] = found
    df = spark.createDataFrame(rows, "r int, c int, t int, diff double, valid boolean")
    got = {x.r: (x.change_index, x.confirmations, x.persistent, x.latest) for x in C.persistence(df, 0.2).collect()}
    assert got == want


@pytest.mark.parametrize("size", [2, 3, 5])
def test_boxcar_against_numpy(spark, size):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 7))
    a[rng.random(a.shape) < 0.4] = np.nan
    lo = size // 2
    hi = size - 1 - lo
    p = np.pad(a, ((lo, hi), (lo, hi)), mode="edge")
    want = np.full(a.shape, np.nan)
    for r in range(9):
        for c in range(7):
            block = p[r : r + size, c : c + size]
            if np.isfinite(block).any():
                want[r, c] = np.nanmean(block)
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(9) for c in range(7)]
    df = C.boxcar(spark.createDataFrame(rows, "r int, c int, v double"), "v", size, 9, 7)
    got = np.full(a.shape, np.nan)
    for x in df.collect():
        got[x.r, x.c] = np.nan if x.v is None else x.v
    np.testing.assert_allclose(got, want)


def test_windows(spark):
    df = spark.sql("select date'2023-01-01' s, date'2024-12-31' e, 4 n")
    got = C.windows(df, "s", "e", "n").orderBy("window").collect()
    assert [str(x.window_start) for x in got] == ["2023-01-01", "2023-07-02", "2024-01-01", "2024-07-02"]
    assert str(got[-1].window_end) == "2024-12-30"


def flood(mask, eight):
    left, out = set(mask), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    while left:
        stack = [left.pop()]
        piece = set(stack)
        while stack:
            r, c = stack.pop()
            for a, b in steps:
                if (r + a, c + b) in left:
                    left.remove((r + a, c + b))
                    piece.add((r + a, c + b))
                    stack.append((r + a, c + b))
        out.append(frozenset(piece))
    return set(out)


@pytest.mark.parametrize(("eight", "tile"), [(True, 256), (False, 256), (True, 7), (False, 7)])
def test_components_in_tiles(spark, eight, tile):
    rng = random.Random(9)
    mask = [(r, c) for r in range(24) for c in range(24) if rng.random() < 0.5]
    df = spark.createDataFrame([("k", r, c) for r, c in mask] + [("other", 0, 0)], "k string, r int, c int")
    got = {}
    for x in R.components(df, 24, 24, eight, ["k"], tile).where("k = 'k'").collect():
        got.setdefault(x.label, set()).add((x.r, x.c))
    assert {frozenset(v) for v in got.values()} == flood(mask, eight)
    assert all(k == min(r * 24 + c for r, c in v) for k, v in got.items())


def test_region_cap_keeps_ties(spark):
    df = spark.createDataFrame([(1, 3), (2, 7), (3, 5), (4, 9), (5, 7)], "label long, pixels long")
    got = R.region_cap(df, 2).collect()
    assert sorted(x.pixels for x in got) == [7, 7, 9] and {x.dropped for x in got} == {2}


def test_sieves(spark):
    mask = spark.createDataFrame([(r, c) for r in range(3, 6) for c in range(3, 6) if (r, c) != (4, 4)] + [(0, 0)], "r int, c int")
    assert R.sieve_drop(mask, 2, 10, 10).count() == 8
    dense = spark.range(100).select(F.expr("cast(id div 10 as int) r"), F.expr("cast(id % 10 as int) c"))
    dense = dense.join(mask.withColumn("on", F.lit(1)), ["r", "c"], "left").fillna(0)
    on = {(x.r, x.c) for x in R.sieve_merge(dense, 2, 10, 10).where("on = 1").collect()}
    # The hole is filled and the speck is gone.
    assert on == {(r, c) for r in range(3, 6) for c in range(3, 6)}


def test_rings_enclose_the_pixels(spark):
    px = [(r, c) for r in range(4) for c in range(4) if (r, c) not in ((1, 1), (2, 2))]
    df = spark.createDataFrame([(0, r, c) for r, c in px], "label long, r int, c int")
    rings = R.rings(df, []).first()["rings"]
    area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(x, x[1:], strict=False)) / 2 for x in rings)
    assert abs(area) == len(px) and len(rings) == 3


def test_sieve_merge_against_the_rule(spark):
    rng = random.Random(5)
    size, n = 5, 14
    on = {(r, c): int(rng.random() < 0.45) for r in range(n) for c in range(n)}
    labels = {}
    for value in (0, 1):
        for piece in flood([p for p, v in on.items() if v == value], False):
            for p in piece:
                labels[p] = (value, min(r * n + c for r, c in piece), len(piece))
    want = {}
    for p in on:
        at, seen = labels[p], set()
        while at[2] < size and at not in seen:
            seen.add(at)
            near = {labels[q] for (r, c), x in labels.items() if x == at for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if q in labels and labels[q][0] != at[0]}
            at = max(near, key=lambda x: (x[2], -x[1]))
        want[p] = at[0] if at[2] >= size else on[p]
    df = spark.createDataFrame([(r, c, v) for (r, c), v in on.items()], "r int, c int, on int")
    assert {(x.r, x.c): x.on for x in R.sieve_merge(df, size, n, n).collect()} == want


def test_components_of_a_snake(spark):
    # One component that winds through every tile, and runs that meet late.
    mask = [(r, c) for r in range(21) for c in range(21) if r % 2 == 0 or c == (20 if r % 4 == 1 else 0)]
    df = spark.createDataFrame(mask, "r int, c int")
    for tile in (256, 8):
        assert {x.label for x in R.components(df, 21, 21, False, tile=tile).collect()} == {0}


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.random(5000), 2)
    got = C.percentiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", [0.0, 0.02, 0.5, 0.98, 1.0]).first()
    np.testing.assert_allclose(list(got), np.quantile(v, [0.0, 0.02, 0.5, 0.98, 1.0]))
    assert list(C.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()) == [None]


def test_numbers_and_running_sums(spark):
    from rasterflux.operators.graph import numbered

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).alias("v")).repartition(7)
    got = {x.k: (x.number, x.total) for x in numbered(df, [F.col("k")], {"total": "v"}).collect()}
    assert got == {k: (k + 1, 2 * k + 2) for k in range(1000)}


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
def test_absent_measurements_are_no_change(spark, odd):
    from rasterflux.functions import exprs as E

    df = spark.createDataFrame([(odd, True)], "d double, v boolean")
    tier = E.tier("d", "v", F.lit(0.0), F.lit(True))
    row = df.select(tier.alias("t"), E.tier(F.lit(0.5), F.lit(True), "d", "v").alias("u"), E.direction("d", "v", 0.2).alias("w"), E.norm_diff("d", F.lit(1.0)).alias("n"), E.vari("d", F.lit(1.0), F.lit(1.0)).alias("g")).first()
    assert (row.t, row.u, row.w, row.n, row.g) == (None, "optical", None, None, None)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "r int, c int")
    assert R.components(empty, 10, 10).count() == 0
    assert C.persistence(spark.createDataFrame([], "r int, c int, t int, diff double, valid boolean"), 0.2).count() == 0


@pytest.mark.parametrize(("shift", "within"), [((0, 0), True), ((-2, 3), True), ((5, -17), True), ((-32, 32), True), ((33, 4), False), ((1, -40), False)])
def test_shift_is_found_at_any_distance(spark, shift, within):
    high, wide = 80, 96
    rng = np.random.default_rng(6)
    a = rng.random((high, wide))
    b = np.roll(a, shift, (0, 1)) + 0.1 * rng.random((high, wide))
    b[3:9, 5:20] = np.nan
    plane = lambda m: spark.createDataFrame([(r, c, float(m[r, c])) for r in range(high) for c in range(wide)], "r int, c int, v double")
    got = C.estimate_shift(plane(a), plane(b).where("r <> 50"), "v", high, wide).first()
    assert (got.dy, got.dx, got.within_tolerance) == (*shift, within) and 0.3 < got.sharpness <= 1
