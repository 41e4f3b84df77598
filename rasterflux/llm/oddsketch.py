"""Near-duplicate components by MinHash bands and odd sketches.

A document's set is its distinct shingles of 4 words, or of 5 in the pipeline's stage (A-Z lower-cased; a shorter text is one shingle). Documents with equal sets are one class. Each class has
MinHash samples; four samples make a band key, and classes that share a band key are candidates. The samples are
also folded into an odd sketch, a bitmap of parities: the number of ones in the XOR of two sketches estimates how many samples differ, with
little error for high similarities, so most candidates are settled without reading a text. The rest are confirmed on their full sets.

A band bucket may hold a third of all classes, so its members are never paired with each other: in each round every
member meets one pivot of its bucket, confirmed links are contracted to components, and buckets whose members are one component are done. Buckets
are salted by their size, so that a hot one is dealt to many tasks. After ``ROUNDS`` such rounds, the members of buckets that still hold different components
meet by a prefix of their sets, in an order that puts rare shingles first. Sets of similarity 0.8 share a shingle within the first fifth of both, and the smaller one has it within its
first ninth, so documents that only share a common passage, whose shingles come last, do not meet at all; nothing is lost to the prefixes. How frequent a shingle is comes from ``CELLS`` counters,
a number that does not grow with the data; any order would give the same links. The members of a prefix shingle first meet its centres, the members with the fewest rare shingles, from which
edited copies differ least, at the ``MEETINGS`` most frequent shingles of each; what is still in several components after ``CENTRE_ROUNDS`` rounds is paired at all shingles, but for the
members of the largest component with each other. In a group of edited copies most such pairs differ too much. A parity bitmap of each set tells so while they are paired: the ones in the XOR of two
are never more than the sets' differing shingles, so it drops no link. No pair is compared twice.

Defined cases: a null text or one without words has an empty set, no links, and is its own component; repeated rows have equal sets and so
share a component; rows without an id are linked like others, their component has the smallest id of the rows with one, and none if there is none (``kept`` holds for a row without an id if its component has no id either);
an empty table gives no rows; extra columns are ignored; very long texts are hashed whole, in blocks.

With 24 bands of 4 samples two sets of similarity 0.8 share no band with probability 3e-6; the sketch limit is 5
standard deviations from the expectation at 0.8 (3e-7).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflux.llm.common import arrow, connected, discard, fresh, materialize

#: Words of a shingle: of the query, and of the pipeline's stage.
SHINGLE, STAGE_SHINGLE = 4, 5
BANDS, ROWS = 24, 4
#: MinHash samples; the bands use the first of them, the sketch all.
SAMPLES = 512
SKETCH_LONGS = 16
#: Most ones in the XOR of two sketches for a pair that goes on to the exact check.
MOST_DIFFERING = 239
#: Counters of how frequent shingles are among the classes whose buckets the pivots have not settled.
CELLS = 1 << 16
#: Hot buckets have more than this share of all band rows, so there are at most as many of them, and are salted into parts of that share.
HOT_SHARE, LEAST_HOT = 10_000, 1000
#: A link: LINK_NUM * union <= LINK_DEN * intersection.
LINK_NUM, LINK_DEN = 80, 100
#: Rounds of pivots in the buckets, and of centres among the members of a prefix shingle.
ROUNDS, CENTRE_ROUNDS = 1, 3
#: Prefix shingles at which a class meets centres. The pairs that follow the centres are made at all shingles.
MEETINGS = 8
#: Longs of the parity bitmap of a set.
PARITY_LONGS = 16
#: Earlier shingles of a prefix that a row carries along, so that a pair is made at the first of several shared shingles only.
BEFORE = 8

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _parities(h: np.ndarray, longs: int) -> np.ndarray:
    """Bitmap of the cells that an odd number of hashes falls into."""
    bit = (h % _U(64 * longs)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(odd).view(">i8").astype(np.int64)


class _Hasher:
    """Shingle hashes from prefix sums of a polynomial in an odd base modulo 2^64 over a random number per byte value."""

    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        rng = np.random.default_rng(20240501)
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = _U(0x5851F42D4C957F2D)
        self.inverse = _U(pow(int(self.base), -1, 1 << 64))
        self.power, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.a = rng.integers(0, 1 << 32, samples, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, samples, dtype=np.uint64).astype(np.uint32)
        self.row = rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | _U(1)
        self.band = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
        self.sample = rng.integers(0, 1 << 63, samples, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, self.base))))
                self.back = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, self.inverse))))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        data = np.frombuffer(b" ".join(words), np.uint8)
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[:n], out=sums[1:])
        blanks = np.flatnonzero(data == 32)
        start = np.concatenate(([0], blanks + 1))
        end = np.concatenate((blanks, [n]))
        k = min(self.shingle, len(words))
        first, last = start[: len(start) - k + 1], end[k - 1 :]
        return np.unique(_mix((sums[last] - sums[first]) * self.back[first] + _U(len(words) < self.shingle)))

    def samples(self, h: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        top = (h >> _U(32)).astype(np.uint32)
        step = max(1, (1 << 19) // len(low))
        for at in range(0, len(top), step):
            block = top[at : at + step]
            np.minimum(low, (self.a[:, None] * block[None, :] + self.b[:, None]).min(axis=1), out=low)
        return low

    def bands(self, low: np.ndarray) -> np.ndarray:
        return _mix((low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS) * self.row).sum(axis=1) + self.band)

    def sketch(self, low: np.ndarray) -> np.ndarray:
        return _parities(_mix(low.astype(np.uint64) * _MULT + self.sample), SKETCH_LONGS)


_hashers: dict[tuple[int, int], _Hasher] = {}


def hasher(samples: int = SAMPLES, shingle: int = SHINGLE) -> _Hasher:
    if (samples, shingle) not in _hashers:
        _hashers[samples, shingle] = _Hasher(samples, shingle)
    return _hashers[samples, shingle]


def node_of(h: np.ndarray) -> int:
    """64-bit name of a set of hashes."""
    with np.errstate(over="ignore"):
        total = _mix(h + _MULT).sum(dtype=np.uint64) + _U(len(h)) * _MULT
    return int(_mix(np.array([total]))[0].astype(np.int64))


def _features(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    hs = hasher(shingle=shingle)
    lists = pa.list_(pa.int64())
    for batch in batches:
        n, node, bands, sketch = [], [], [], []
        for text in batch.column(1):
            h = hs.shingles(text.as_py())
            n.append(len(h))
            if not len(h):
                node.append(None), bands.append(None), sketch.append(None)
                continue
            low = hs.samples(h)
            node.append(node_of(h))
            bands.append(hs.bands(low).view(np.int64))
            sketch.append(hs.sketch(low))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, lists), pa.array(sketch, lists)],
            ["doc_id", "key", "n_shingles", "node", "bands", "sketch"],
        )


def features(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, node (name of the set), band keys and odd sketch."""
    return arrow(
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")),
        partial(_features, shingle=shingle),
        "doc_id long, key long, n_shingles long, node long, bands array<bigint>, sketch array<bigint>",
    )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Name and set of each row (node, text)."""
    hs = hasher(shingle=shingle)
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = hs.shingles(text.as_py())
            if len(h) and node_of(h) == node:
                yield node, h


def _cell(h: np.ndarray) -> np.ndarray:
    return (h % _U(CELLS)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for _, h in _sets(batches, shingle):
        total += np.bincount(_cell(h), minlength=CELLS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["cell", "n"])


def _prefix_rows(batches: Iterator[pa.RecordBatch], shingle: int, counts: bytes) -> Iterator[pa.RecordBatch]:
    """node, size, shingle, left (shingles of the set from this one on in the order) of each set's prefix."""
    order = np.frombuffer(counts, np.uint8)
    schema = pa.schema([(c, pa.int64()) for c in ("node", "size", "shingle", "left")])
    held: list[tuple[np.ndarray, ...]] = []

    def batch() -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], schema=schema)

    for node, h in _sets(batches, shingle):
        n = len(h)
        rank = order[_cell(h)]
        h = h[np.lexsort((h, rank))]
        # Another set has at least LINK_NUM / LINK_DEN times as many shingles.
        first = n - -(-LINK_NUM * n // LINK_DEN) + 1
        at = np.flatnonzero(order[_cell(h[:first])] > 0)
        held.append((np.full(len(at), node), np.full(len(at), n), h[at], n - at))
        if sum(len(x[0]) for x in held) > 10_000:
            yield batch()
    if held:
        yield batch()


def _parity_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """node, parity of each set, in batches."""
    schema = pa.schema([("node", pa.int64()), ("parity", pa.list_(pa.int64()))])
    for batch in batches:
        nodes, parity = [], []
        for node, h in _sets(iter([batch]), shingle):
            nodes.append(node), parity.append(_parities(_mix(h + _MULT), PARITY_LONGS))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parity, schema.field(1).type)], schema=schema)


def _texts(used: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the classes in ``used``. Rows of one id, or without an id, that have equal texts are merged in the tasks."""
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    rep = nodes.select("node", "rep.*").join(used, "node")
    found = rep.join(text, rep["id"].eqNullSafe(text["id"]) & (rep["key"] == text["key"]))
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _confirm(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    hs = hasher(shingle=shingle)
    recent: OrderedDict[int, np.ndarray | None] = OrderedDict()

    def full(node: int, text: str) -> np.ndarray | None:
        if node not in recent:
            h = hs.shingles(text)
            # A document id that several texts share brings them all; only the set that was named counts.
            h = h if node_of(h) == node else None
            if len(recent) >= 32:
                recent.popitem(last=False)
            recent[node] = h
        return recent[node]

    for batch in batches:
        out_a, out_b = [], []
        cols = [batch.column(k) for k in range(4)]
        for a, b, ta, tb in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2], cols[3], strict=True):
            hb, ha = full(b, tb.as_py()), hs.shingles(ta.as_py())
            if hb is None or not len(ha) or node_of(ha) != a:
                recent.pop(b, None) if hb is None else None
                continue
            common = len(np.intersect1d(ha, hb, assume_unique=True))
            if LINK_DEN * common >= LINK_NUM * (len(ha) + len(hb) - common):
                out_a.append(a), out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sketches differ in few enough bits."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_differing("s_a", "s_b", SKETCH_LONGS) <= MOST_DIFFERING).select("a", "b")


def _differing(a: str, b: str, longs: int) -> Column:
    """Ones in the XOR of two bitmaps."""
    bits = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(longs)]
    return sum(bits[1:], bits[0])


def _links(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Pairs that are links on their full sets, from the texts of their classes."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
    return arrow(rows, partial(_confirm, shingle=shingle), "a long, b long").distinct()


def _buckets(nodes: DataFrame) -> DataFrame:
    """node, band, n (rows of the bucket), salt and comp of the classes that share a band key with another."""
    members = nodes.select("node", F.explode("bands").alias("band"))
    limit = max(LEAST_HOT, nodes.count() * BANDS // HOT_SHARE)
    per = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    per = materialize(per, "near-shared")
    # At most HOT_SHARE rows.
    hot = F.broadcast(per.where(F.col("n") > limit).select("band", F.expr(f"n div {limit}").alias("parts")))
    salted = members.join(hot, "band", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(0)) + 1)).drop("parts")
    out = salted.join(_salted(per.withColumn("parts", F.expr(f"n div {limit}"))), ["band", "salt"])
    out = materialize(out.select("node", "band", "n", "parts", "salt", F.col("node").alias("comp")), "near-buckets")
    discard(per)
    return out


def _salted(per_band: DataFrame) -> DataFrame:
    """One row per bucket for each of its parts."""
    return per_band.select(*[c for c in per_band.columns if c != "salt"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))).alias("salt"))


def _prefixes(texts: DataFrame, shingle: int) -> DataFrame:
    """node, size, shingle, left of the prefixes of all classes in ``texts``, without shingles that no other set can have."""
    counts = arrow(texts, partial(_cell_counts, shingle=shingle), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # At most CELLS rows. Only the order of magnitude counts; a cell of one shingle is of no other set.
    magnitude = bytearray(CELLS)
    for r in counts.collect():
        magnitude[r["cell"]] = (r["n"] - 1).bit_length()
    rows = arrow(texts, partial(_prefix_rows, shingle=shingle, counts=bytes(magnitude)), "node long, size long, shingle long, left long")
    return materialize(rows, "near-prefixes")


#: The smaller set of a pair has its first common shingle so early that even an equal set could be similar.
_EARLY = f"{LINK_NUM + LINK_DEN} * left >= {LINK_NUM} * 2 * size"
#: What is left of both sets from a common shingle on is enough for a link.
_FITS = " and ".join(f"{LINK_NUM + LINK_DEN} * left_{c} >= {LINK_NUM} * (size_a + size_b)" for c in "ab")


def _open_prefixes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of shingles that classes of several components share and one of them early, with comp, the shingle's largest component (major) and its rows (members)."""
    rows = rows.join(labels, "node")
    per = rows.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(_EARLY)).alias("early"))
    per = per.groupBy("shingle").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("comps"), F.max("early").alias("early")
    )
    return materialize(rows.join(per.where("comps > 1 and early").select("shingle", "major", "members"), "shingle"), "near-open")


def _pairs_of(both: DataFrame, *also: Column | str) -> DataFrame:
    both = both.where("comp_a != comp_b").where(_FITS)
    for condition in also:
        both = both.where(condition)
    return both.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _centres(open_: DataFrame) -> DataFrame:
    """Two centres of each shingle: of the largest component and of the others, the member whose own rare shingles are fewest.

    That is the text from which most of a group of edited copies differ least.
    """
    share, who = F.col("left") / F.col("size"), F.struct("node", "comp", "size", "left")
    centre = lambda of: F.max_by(F.when(of, who), F.when(of, F.struct(share, "node")))
    major = F.col("comp") == F.col("major")
    centres = open_.groupBy("shingle").agg(F.array(centre(major), centre(~major)).alias("centres")).select("shingle", F.explode("centres").alias("x"))
    return materialize(centres.select("shingle", *[F.col(f"x.{k}").alias(f"{k}_b") for k in ("node", "comp", "size", "left")]), "near-centres")


def _with_centres(open_: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of members with centres. A group shares many shingles with the same few centres, so a member meets those of ``MEETINGS`` shingles: of the most frequent ones, the first
    in its order, where the most pairs fit."""
    own = W.partitionBy("node").orderBy(F.floor(F.log2("members")).desc(), F.desc("left"))
    members = open_.withColumn("meeting", F.row_number().over(own)).where(F.col("meeting") <= MEETINGS)
    members = members.select("shingle", *[F.col(k).alias(f"{k}_a") for k in ("node", "comp", "size", "left")])
    return _pairs_of(members.join(centres, "shingle"))


def _across(open_: DataFrame, parities: DataFrame | None = None) -> DataFrame:
    """All pairs of a shingle's members, but for those within its largest component.

    All prefixes have one order, and what holds for a pair at a shared shingle holds at an earlier one too. So a pair that shares one of the ``BEFORE`` shingles before is not made again:
    at the first of all that it shares, nothing before is shared. Where both members are early, the one with the smaller name pairs. With the ``parities`` of all sets,
    pairs whose parities alone differ too much for a link are not made.
    """
    kept, also = ["node", "comp", "size", "left"], []
    if parities is not None:
        open_ = open_.join(parities, "node")
        kept.append("parity")
        also.append((LINK_DEN + LINK_NUM) * _differing("parity_a", "parity_b", PARITY_LONGS) <= (LINK_DEN - LINK_NUM) * (F.col("size_a") + F.col("size_b")))
    upto = W.partitionBy("node").orderBy(F.desc("left")).rowsBetween(-BEFORE, -1)
    rows = open_.withColumns({"before": F.collect_list("shingle").over(upto), "early": F.expr(_EARLY)})
    side = lambda c: rows.select(
        "shingle", *[F.col(x).alias(f"{x}_{c}") for x in (*kept, "before", "early")], (F.col("comp") == F.col("major")).alias(f"major_{c}")
    )
    small, large = side("a").where("early_a"), side("b")
    others = small.where("not major_a").join(large, "shingle").where("major_b or not early_b or node_a < node_b")
    rest = small.where("major_a").join(large.where("not major_b and not early_b"), "shingle")
    return _pairs_of(others.unionByName(rest), *also, "not arrays_overlap(before_a, before_b)")


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    feats = materialize(features(docs, shingle), "near-features")
    # Equal rows of a class bring equal features; any is the class's. They are merged in the tasks, so a large class costs its tasks one row each.
    nodes = feats.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").alias("id"), "key")).alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    nodes = materialize(nodes, "near-classes")
    labels = materialize(nodes.select("node", F.col("node").alias("comp")), "near-labels")
    sketches = nodes.select("node", "sketch")

    def contract(pairs: DataFrame, labels: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, bool]:
        """The labels once the links among the pairs are contracted, and whether there were any. Without ``texts`` those of the pairs are looked up."""
        near = materialize(_estimated(pairs, sketches), "near-pairs")
        used = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        links = materialize(_links(near, _texts(used, nodes, docs) if texts is None else texts, shingle), "near-links")
        if links.isEmpty():
            discard(near, links)
            return labels, False
        comp = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}"))
        merged = connected(links.join(comp("a"), "a").join(comp("b"), "b"), "c_a", "c_b").select(F.col("node").alias("comp"), "root")
        out = materialize(labels.join(merged, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "near-labels")
        discard(labels, near, links)
        return out, True

    members = _buckets(nodes)
    for k in range(ROUNDS + 1):
        open_ = members.groupBy("band").agg(
            F.min("comp").alias("lo"),
            F.max("comp").alias("hi"),
            F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("order"), "node", "comp")).alias("p"),
            F.first("parts").alias("parts"),
            F.first("n").alias("n"),
        )
        # A pair has been compared once its first pivot was.
        open_ = _salted(open_.where("lo != hi").where(F.lit(k == 0) | (F.col("n") > 2)).select("band", "p", "parts"))
        older, members = members, materialize(members.join(open_.drop("parts"), ["band", "salt"]), "near-buckets")
        discard(older)
        if k == ROUNDS or members.isEmpty():
            break
        pairs = materialize(members.where("comp != p.comp").select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b")).distinct(), "near-pivots")
        labels, _ = contract(pairs, labels)
        discard(pairs)
        older, members = members, materialize(members.drop("p", "comp").join(labels, "node"), "near-buckets")
        discard(older)
    # The texts of what is left are looked up once.
    texts = None if members.isEmpty() else materialize(_texts(members.select("node").distinct(), nodes, docs), "near-texts")
    rows = None if texts is None else _prefixes(texts, shingle)
    # Only the unsettled classes are labelled anew in each round; the others follow their components at the end.
    before, labels = labels, labels if texts is None else materialize(labels.join(texts.select("node"), "node", "left_semi"), "near-labels")
    parities = None if texts is None else materialize(arrow(texts, partial(_parity_rows, shingle=shingle), "node long, parity array<bigint>"), "near-parities")
    centres_left, more, compared, met = CENTRE_ROUNDS, rows is not None, [], []
    while more:
        open_ = _open_prefixes(rows, labels)
        if open_.isEmpty():
            break
        # Centres that brought no link would bring none again.
        more = centres_left > 0
        if more:
            # A shingle's members have met its earlier centres.
            met.append(_centres(open_))
            new = met[-1]
            for older in met[:-1]:
                new = new.join(older.select("shingle", "node_b"), ["shingle", "node_b"], "left_anti")
            pairs = _with_centres(open_, new)
        else:
            pairs = _across(open_, parities)
        for older in compared:
            pairs = pairs.join(older, ["a", "b"], "left_anti")
        compared.append(materialize(pairs, "near-candidates"))
        labels, linked = contract(compared[-1], labels, texts)
        centres_left = centres_left - 1 if linked else 0
        discard(open_)
    if texts is not None:
        moved = before.join(labels.select("node", F.col("comp").alias("root")), "node").where("comp != root").select("comp", "root").distinct()
        labels = materialize(before.join(moved, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "near-labels")
    discard(rows, texts, parities, members, *compared, *met)
    least = labels.join(nodes.select("node", "least"), "node")
    firsts = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = least.select("node", "comp").join(firsts, "comp").select("node", "component_id")
    return feats.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op5(docs: DataFrame) -> DataFrame:
    return components(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """One row of each component, that with the smallest id, with its own columns.

    Components are found over rows, not ids: a row without an id or with the id of another text is a document of its own, and without an id comes last.
    """
    row = fresh(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = components(rows.select(F.col(row).alias("doc_id"), "text"), shingle).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))
    kept = rows.select(row, "doc_id").join(found, row).groupBy("component_id").agg(first.alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
