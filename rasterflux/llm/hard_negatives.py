"""Hard negatives by norm-bucketed inner-product search.

Candidates are sorted by the length of their vectors, longest first, and cut into chunks, and a chunk into buckets. The inner product of an anchor with anything in a chunk or
bucket is at most the anchor's length times that of the longest vector there (Cauchy-Schwarz), so an anchor visits only the chunks, and in a task only the buckets, whose bound
reaches what it still asks for: the lower limit of its windows, or the score of the k-th candidate found so far where that is higher. All anchors first search the chunk of the longest vectors; the
k-th scores found there limit how far down the other chunks each anchor is sent. In vectors of equal length nothing is pruned, and every anchor meets every candidate, in blocks.

Anchors and candidates meet in cells (chunk, group of anchors), both of bounded size: a cell is one group of a cogrouped task. No task holds more than one cell, whatever a label or a vector's
number of copies; results of an anchor's cells are merged by rank.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; components beyond 32 bits keep the largest such value; a shorter
vector counts as padded with zeros, an empty one has score 0 with all; a null id comes last in ties and is no anchor; repeated rows are rows of their own, so a copy of an anchor may be its positive and repeated anchors
give repeated results; scores are exact below 2^63. An anchor without others of its label has no positives and no rows; a positive of negative score has an empty window.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterflux.llm.common import discard, materialize, numbered
from rasterflux.shipping import ship

#: Rows of a chunk of candidates: as many as give CHUNKS of them, between these bounds; most anchors of a group.
LEAST_CHUNK, MOST_CHUNK, CHUNKS, GROUP = 4096, 1 << 18, 256, 1 << 16
#: Candidates of a bucket and anchors of a tile that are multiplied at once.
BUCKET, TILE = 1024, 1024
#: Most lengths of chunks that an anchor's reach is looked up in.
MARKS = 1024
POSITIVES, NEGATIVES = 5, 5
#: Per cent of the positive's score between which a hard negative's lies.
LOW, HIGH = 80, 100
EVERY = 100
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_SLACK = 1 + 1e-9
_FOUND = "row long, w int, score long, id long, kth long"


def candidates(vectors: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label, vec (whole 1/256ths), norm and chunk of the rows that take part, in chunks of descending norm."""
    x = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    x = x.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    x = x.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = F.transform("x", lambda v: F.floor(F.least(F.greatest(v * 256, F.lit(-2.0**31)), F.lit(2.0**31 - 1))).cast("int"))
    x = x.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("vec"))
    x = x.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v)))
    ranked = numbered(x, [F.col("norm").desc(), F.col("row")])
    n = ranked.count()
    rows = max(LEAST_CHUNK, min(MOST_CHUNK, n // CHUNKS))
    out = materialize(ranked.withColumn("chunk", F.expr(f"cast((number - 1) div {rows} as int)")).drop("number"), "norm-chunks")
    discard(ranked)
    return out


def _matrix(column: pa.ChunkedArray, fill: int = 0) -> np.ndarray:
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(size.max(initial=0))
    if (size == wide).all():
        return values.reshape(len(size), wide)
    out = np.full((len(size), wide), fill)
    out[np.arange(wide) < size[:, None]] = values
    return out


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide].T
    # Below 2^53 sums of products are exact in doubles.
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if bound < 2.0**53 else a @ b


def _cell(anchors: pa.Table, found: pa.Table, k: int, same: bool) -> pa.Table:
    """The first k candidates of each window of each anchor in one cell; kth is the window's k-th score, null if there are fewer."""
    col = lambda t, name: t.column(name).to_numpy()
    found = found.sort_by([("norm", "descending")])
    c_vec, c_norm, c_label, c_row = _matrix(found.column("vec")), col(found, "norm"), col(found, "label"), col(found, "row")
    c_id = found.column("vec_id").fill_null(_MOST).to_numpy()
    q_vec, q_norm, q_label, q_row = _matrix(anchors.column("vec")), col(anchors, "norm"), col(anchors, "label"), col(anchors, "row")
    # A window that an anchor lacks is empty.
    low, high = _matrix(anchors.column("low"), _MOST), _matrix(anchors.column("high"), _LEAST)
    windows = low.shape[1]
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q_row) if len(c_row) else 0, TILE):
        t = slice(at, at + TILE)
        n = len(q_row[t])
        score = np.full((windows, n, k), _LEAST)
        ident = np.full((windows, n, k), _MOST)
        for b in range(0, len(c_row), BUCKET):
            s = slice(b, b + BUCKET)
            floor = np.maximum(low[t].T, score[:, :, -1])
            reach = q_norm[t] * c_norm[b] * _SLACK >= floor.min(axis=0)
            if not reach.any():
                break
            q = np.flatnonzero(reach)
            products = _products(q_vec[t][q], c_vec[s], float(q_norm[t].max()) * c_norm[b])
            other = (q_label[t][q][:, None] == c_label[s][None, :]) != same
            if same:
                other |= q_row[t][q][:, None] == c_row[s][None, :]
            for w in range(windows):
                v = np.where(other | (products < floor[w][q][:, None]) | (products > high[t][q, w][:, None]), _LEAST, products)
                rows = np.flatnonzero((v > _LEAST).any(axis=1))
                if not len(rows):
                    continue
                v = v[rows]
                least = np.partition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k] if v.shape[1] > k else np.full(len(rows), _LEAST)
                r, c = np.nonzero((v >= least[:, None]) & (v > _LEAST))
                seen = q[rows]
                r = np.concatenate((np.repeat(np.arange(len(seen)), k), r))
                pool = np.concatenate((score[w, seen].ravel(), v[r[len(seen) * k :], c]))
                names = np.concatenate((ident[w, seen].ravel(), c_id[s][c]))
                order = np.lexsort((names, ~pool, r))
                first = np.searchsorted(r[order], np.arange(len(seen)))
                take = order[first[:, None] + np.arange(k)]
                score[w, seen], ident[w, seen] = pool[take], names[take]
        for w in range(windows):
            q, place = np.nonzero(score[w] > _LEAST)
            out.append((q_row[t][q], np.full(len(q), w, np.int32), score[w][q, place], ident[w][q, place], score[w][q, -1]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
    row, w, score, ident, kth = cols
    return pa.table(
        {"row": pa.array(row, pa.int64()), "w": pa.array(w.astype(np.int32)), "score": pa.array(score, pa.int64()), "id": pa.array(ident, pa.int64(), mask=ident == _MOST), "kth": pa.array(kth, pa.int64(), mask=kth == _LEAST)}
    )


def _visit(anchors: DataFrame, found: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """Anchors (row, label, vec, norm, low, high, chunk) against the candidates of their chunks."""
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")
    left = anchors.select("row", "label", "vec", "norm", "low", "high", "chunk", group)
    right = found.select("row", "vec_id", "label", "vec", "norm", "chunk", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    ship(found.sparkSession)
    return left.groupBy("chunk", "group").cogroup(right.groupBy("chunk", "group")).applyInArrow(partial(_cell, k=k, same=same), _FOUND)


def search(anchors: DataFrame, found: DataFrame, k: int, same: bool) -> DataFrame:
    """row, w, rank, score, id: the first k candidates of each window of each anchor, by score and then smaller id.

    ``anchors`` has row, label, vec, norm and the arrays low and high, with the inclusive limits of the score in each window. With ``same`` other rows of
    the anchor's label are searched, else those of other labels.
    """
    chunks = (found.agg(F.max("chunk")).first()[0] or 0) + 1
    groups = max(1, -(-anchors.count() // GROUP))
    first = _visit(anchors.withColumn("chunk", F.lit(0)), found.where("chunk = 0"), groups, k, same)
    first = materialize(first, "negatives-first")
    every = first
    if chunks > 1:
        step = -(-chunks // MARKS)
        marks = found.where(F.col("chunk") % step == 0).groupBy("chunk").agg(F.max("norm").alias("norm")).orderBy("chunk").collect()
        lengths = F.array(*[F.lit(float(m.norm)) for m in marks])
        kth = first.where("kth is not null").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("w", "kth"))).alias("kth"))
        rest = anchors.join(kth, "row", "left")
        rest = rest.withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.try_element_at("kth", i)))).withColumn("need", F.array_min("low"))
        reached = F.size(F.filter(lengths, lambda m: m * F.col("norm") * _SLACK >= F.col("need"))) * step
        rest = rest.withColumn("to", F.least(reached, F.lit(chunks)) - 1).where("to >= 1").withColumn("chunk", F.explode(F.sequence(F.lit(1), F.col("to"))))
        every = first.union(_visit(rest, found.where("chunk > 0"), groups, k, same))
    best = W.partitionBy("row", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    out = materialize(every.select("row", "w", "score", "id", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k), "negatives")
    discard(first)
    return out


def mine(
    vectors: DataFrame, label: Column | None = None, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every anchor and each of its best ``positives`` rows of the same label: the best ``negatives`` rows of other labels whose score is between ``low`` and ``high`` per cent
    of the positive's.
    """
    found = candidates(vectors, F.col("label").cast("long") if label is None else label)
    asked = materialize(found.where(F.col("vec_id") % EVERY == 0 if anchor is None else anchor), "anchors")
    whole = lambda x: F.array(F.lit(x).cast("long"))
    near = search(asked.withColumns({"low": whole(_LEAST), "high": whole(_MOST)}), found, positives, same=True)
    # low * score / 100 rounded up and high * score / 100 rounded down, without leaving the range of a long.
    share = lambda per_cent, up: F.expr(f"{per_cent} * (score div 100) + ({per_cent} * (score % 100) + {up}) div 100")
    w = near.where("score >= 0").select("row", F.struct("rank", share(low, 99).alias("low"), share(high, 0).alias("high")).alias("w"))
    w = w.groupBy("row").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    hard = search(asked.join(w, "row").withColumns({"low": F.col("ws.low"), "high": F.col("ws.high")}).drop("ws"), found, negatives, same=False)
    # Windows follow the positives with a score of at least 0, which are the first ones.
    pairs = near.select("row", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row")
    out = hard.join(pairs, ["row", "w"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; the label of ids divisible by 7 becomes the next one first."""
    label = F.col("label").cast("long")
    return mine(vectors, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
