"""Percentiles of several columns at once and ranks for many prompts, against numpy."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterflux.operators import change as C
from rasterflux.operators import scenes as S


def test_percentiles_of_all_columns_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 3000
    a = rng.normal(size=n)
    # Values over all magnitudes, one repeated value, both ends of the range, few values.
    b = np.exp(rng.uniform(-600, 600, n)) * rng.choice([-1, 1], n)
    c = np.full(n, 7.0)
    d = rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324], n)
    rows = [tuple(map(float, x)) + (None,) for x in zip(a, b, c, d)] + [(float("nan"), float("inf"), None, float("-inf"), None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    shares = [0.0, 0.02, 0.37, 0.5, 0.98, 1.0]
    got = C.exact_percentiles(df, {k: F.col(k) for k in "abcde"}, shares)
    assert got["e"] == [None] * 6
    for name, v in zip("abc", (a, b, c)):
        np.testing.assert_allclose(got[name], np.quantile(v, shares), rtol=1e-12)
    for x, p in zip(got["d"], shares):
        place = (n - 1) * p
        low, high = np.sort(d)[[int(np.floor(place)), int(np.ceil(place))]]
        assert low <= x <= high or low == high == x


def test_passes_are_shared(spark, monkeypatch):
    """A thousand distinct values of three columns take one pass for the bounds, and two more for all ranks together."""
    df = spark.range(1000).select(*[(F.col("id") * k + F.col("id") % 7 / 10).alias(f"c{k}") for k in (1, 3, 5)])
    calls = []
    agg = type(df.groupBy("c1")).agg
    monkeypatch.setattr(type(df.groupBy("c1")), "agg", lambda self, *x: calls.append(1) or agg(self, *x))
    C.exact_percentiles(df, {k: F.col(k) for k in df.columns}, [0.02, 0.5, 0.98])
    assert len(calls) <= 2


def test_ranks_for_many_prompts(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_VECTORS", 40)
    monkeypatch.setattr(S, "CELL_PROMPTS", 3)
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (150, 5)).astype(float)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(900, None)]
    prompts = [(f"p{i}", v[i * 10].tolist()) for i in range(8)] + [("none", None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in S.rank_by_prompts(df, spark.createDataFrame(prompts, "prompt string, embedding array<double>"), 6).orderBy("prompt", "rank").collect():
        got.setdefault(r.prompt, []).append((r.feature_index, r.score, r.rank))
    assert set(got) == {p for p, x in prompts if x}
    for p, x in prompts[:-1]:
        one = [(r.feature_index, r.score, r.rank) for r in S.rank_by_vector(df.where("embedding is not null"), x, 6).collect()]
        assert got[p] == sorted(one, key=lambda r: r[2])
    assert S.rank_by_prompts(df, spark.createDataFrame([], "prompt string, embedding array<double>"), 6).count() == 0


def test_a_cell_of_prompts_holds_few_scores_at_once():
    """The scores of a whole cell are never in memory together, and those of every prompt are right."""
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(20_000, 8)), rng.normal(size=(S.CELL_PROMPTS, 8))
    vectors = pa.table({"id": pa.array(range(len(v))), "v": pa.array(v.tolist())})
    prompts = pa.table({"prompt": pa.array(range(len(q))), "v": pa.array(q.tolist())})
    tracemalloc.start()
    got = S._best_of_cell(vectors, prompts, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(v) * len(q) * 8 / 4
    want = [(p, i) for p, row in enumerate(q @ v.T) for i in np.lexsort((np.arange(len(v)), -row))[:5]]
    assert list(zip(got["prompt"].to_pylist(), got["feature_index"].to_pylist(), strict=True)) == want


def test_equal_vectors_tie_for_every_prompt():
    """Copies of a vector have one score wherever they stand in the matrix, so ids order them."""
    rng = np.random.default_rng(6)
    few, q = rng.normal(size=(77, 64)), rng.normal(size=(67, 64))
    v = np.concatenate([few] * 13)
    vectors = pa.table({"id": pa.array(range(len(v))), "v": pa.array(v.tolist())})
    got = S._best_of_cell(vectors, pa.table({"prompt": pa.array(range(len(q))), "v": pa.array(q.tolist())}), 20)
    scores = np.cumsum(q[:, None, :] * v[None, :, :], axis=2)[:, :, -1]
    want = [(p, i) for p, row in enumerate(scores) for i in np.lexsort((np.arange(len(v)), -row))[:20]]
    assert list(zip(got["prompt"].to_pylist(), got["feature_index"].to_pylist(), strict=True)) == want
