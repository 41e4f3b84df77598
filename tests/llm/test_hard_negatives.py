"""Hard negatives against a brute force over all rows."""

from __future__ import annotations

import math
import random

import pytest

from rasterflux.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, norm double, chunk int, kth long, low long"


def brute(rows):
    part = []
    for n, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        part.append((n, i, label, [math.floor(256 * v) for v in x]))
    last = lambda i: (i is None, i or 0)
    out = []
    for n, i, label, x in part:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), last(j), j, other) for m, j, other, y in part if m != n), key=lambda r: r[:2])
        for s, _, j, other in [r for r in scored if r[3] == label][:5]:
            fit = [r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, r[2], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(n, dims, seed, long_tail=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # Quarters are exact in floats.
        x = [rng.randint(-40, 40) / 64 for _ in range(dims)]
        scale = 2 ** rng.randint(-4, 2) if long_tail else 1
        rows.append((i, [v * scale for v in x], rng.choice([0, 0, 0, 1, 2, 9])))
    return rows + [(n + 1, rows[3][1], 4), (n + 2, rows[3][1], 4), (3, rows[3][1], 0)]


def found(spark, rows):
    full = [(*r, 1, 2.0, 3, 4, 5) for r in rows]
    got = hard_negatives.op12(spark.createDataFrame(full, SCHEMA)).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("chunk, group, tail", [(4096, 1 << 16, True), (64, 2, True), (64, 2, False)])
def test_equals_brute_force(spark, monkeypatch, chunk, group, tail):
    monkeypatch.setattr(hard_negatives, "LEAST_CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rows = vectors(600, 6, chunk, tail)
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows) == want


def test_short_vectors_are_not_visited(spark, monkeypatch):
    """Chunks whose longest vector cannot reach an anchor's k-th score get no rows of it."""
    monkeypatch.setattr(hard_negatives, "LEAST_CHUNK", 64)
    met = []
    visit = hard_negatives._visit
    monkeypatch.setattr(hard_negatives, "_visit", lambda a, *rest: met.append(a.count()) or visit(a, *rest))
    rows = vectors(600, 6, 1)
    hard_negatives.op12(spark.createDataFrame([(*r, 1, 2.0, 3, 4, 5) for r in rows], SCHEMA)).collect()
    # Six anchors, nine more chunks.
    assert met[0] == 6 and met[1] < 6 * 9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [], 1), (200, [-1.0, -1.0], 2), (300, None, 1), (400, [1.0, None], 1), (500, [nan, 1.0], 1), (600, [1.0, inf], 1), (700, [1.0, 1.0], None),
        (1, [1.0, 0.25], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 3), (None, [0.9, 0.5], 2), (4, [1.0, 0.5, 9.0], 5), (5, [0.9], 6), (6, [1.0, 1.0], 2), (7, [1.0, 0.4], 0), (900, [5.0, 5.0], 77),
    ]
    # A score of zero is in the window of a positive with zero only.
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], None)]) == []


def test_long_components(spark):
    """Scores beyond 2^53 are exact; components beyond 32 bits keep the largest such value."""
    rows = [(100, [2.0**21, 1.0], 1), (1, [2.0**21, 3.0], 1), (2, [2.0**21, 2.0], 2), (3, [2.0**21, 2.5], 2), (4, [-1e38, 1e38], 3)]
    score = lambda y: 2**58 + 65536 * y
    assert found(spark, rows) == [(100, 1, 1, 3, int(score(3)), int(score(2.5))), (100, 1, 2, 2, int(score(3)), int(score(2)))]
