"""Toxicity by compression distance.

Two Zstandard dictionaries are trained on labelled text: one on windows of ordinary documents, one on toxic text, which is the passages of toxic documents whose byte
grams are far more frequent there than in ordinary ones. A window of a text is compressed once with the ordinary dictionary and once with
the ordinary dictionary followed by the toxic one; the bytes that the second saves are the window's distance. A text's largest and mean savings and
the shares of windows beyond two thresholds are calibrated to a probability by a logistic fit on labelled documents that trained none of the dictionaries they are measured with.
The thresholds are the savings that ``BEYOND`` of such documents' ordinary windows do not reach.

A toxic document is mostly ordinary prose, so a dictionary trained on all of it and compared by itself tells little (the README has figures): hence the
passages, and hence the ordinary dictionary before the toxic one, both as plain content, which leaves nothing but toxic text to save by.

The fit uses a bounded sample of labelled rows: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` whole documents, in the order of a hash, of ``MAX_CHARS`` characters a class together;
the dictionaries are trained on at most ``TRAINED`` ordinary windows and ``REPEATS`` repeats of a passage. Scoring reads every whole text. Rows of the held-out
fold, crc32 of the id as text modulo 3 equal to 1, are never learnt from.

Defined cases: a null or empty text is one empty window with distance 0; where labels hold no documents of one class,
every score is 0; several labels of a document count as toxic if one does; repeated rows get equal scores and are learnt from once; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import arrow

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 3000, 6000, 40_000_000
#: Most ordinary windows and repeats of a toxic passage that the dictionaries are trained on.
TRAINED, REPEATS = 100_000, 50
#: Bytes of a window and between the starts of two.
WINDOW, STEP = 48, 36
GRAMS, GRAM_BITS = (5, 9), 22
#: MinHash samples of a document (2 to this power), and the share of equal ones from which it is a near copy.
MARK_BITS, COPY_FROM = 7, 0.5
#: Least z score and ratio of document shares for a gram of the toxic passages.
LEAST_Z, LEAST_RATIO = 4.5, 30.0
ORDINARY_BYTES, TOXIC_BYTES = 32 * 1024, 2048
LEVEL = 3
#: Shares of ordinary windows that save less than the two thresholds.
BEYOND = (0.99, 0.999)
PREDICTED_FROM = 0.7


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)]


def _hashes(data: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < size:
        return np.empty(0, np.uint64)
    h = np.full(len(a) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + a[k : len(a) - size + 1 + k]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _grams(data: bytes, size: int) -> np.ndarray:
    return (_hashes(data, size) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _marks(data: bytes) -> np.ndarray:
    """The least gram hash of each slice of the hashes, 32 bits of it; 0 in a slice without grams."""
    h = np.unique(_hashes(data, 9))
    slices, at = np.unique(h >> np.uint64(64 - MARK_BITS), return_index=True)
    marks = np.zeros(1 << MARK_BITS, np.uint32)
    marks[slices.astype(np.int64)] = np.maximum(h[at] >> np.uint64(25) & np.uint64(0xFFFFFFFF), np.uint64(1))
    return marks


def distinct_documents(docs: list[bytes]) -> list[bytes]:
    """Documents without near copies of earlier ones, whose passages would count as often as they are copied.

    A near copy has at least half of its MinHash samples in common with one and the same earlier document, so what is dropped
    doesn't depend on how many unrelated documents there are: at a similarity of 0.2 the limit is 8 standard deviations away.
    """
    seen = np.zeros((len(docs), 1 << MARK_BITS), np.uint32)
    out = []
    kept = 0
    for data in docs:
        marks = _marks(data)
        if marks.any():
            equal = seen[:kept] == marks
            both = equal[:, marks > 0].sum(axis=1)
            either = len(marks) - equal[:, marks == 0].sum(axis=1)
            if (both >= COPY_FROM * either).any():
                continue
            seen[kept] = marks
            kept += 1
        out.append(data)
    return out


def marked_grams(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Which gram hashes are far more frequent in toxic documents."""
    share = []
    toxic, ordinary = distinct_documents(toxic), distinct_documents(ordinary)
    for group in (toxic, ordinary):
        seen = np.zeros(1 << GRAM_BITS, np.int32)
        for data in group:
            for size in GRAMS:
                seen[np.unique(_grams(data, size))] += 1
        share.append(seen / max(1, len(group)))
    t, o = share
    nt, no = max(1, len(toxic)), max(1, len(ordinary))
    both = (t * nt + o * no) / (nt + no)
    z = (t - o) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / nt + 1 / no))
    return (z >= LEAST_Z) & (t >= LEAST_RATIO * o)


def passages(data: bytes, marked: np.ndarray) -> list[bytes]:
    """Maximal stretches covered by marked grams."""
    cover = np.zeros(len(data) + 2, np.int8)
    for size in GRAMS:
        for k in np.flatnonzero(marked[_grams(data, size)]):
            cover[k + 1 : k + 1 + size] = 1
    edge = np.diff(cover)
    return [data[s:e] for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the last of the samples where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    thresholds: tuple[float, ...] = (1.0, 1.0)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def prepare(self) -> None:
        import zstandard

        made = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )
        self._with_ordinary, self._with_toxic = made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def savings(self, data: bytes) -> np.ndarray:
        """Bytes that each window saves by the toxic dictionary."""
        plain, toxic = self._with_ordinary, self._with_toxic
        ws = windows(data)
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in ws), np.float64, len(ws))

    def measure(self, saved: np.ndarray) -> np.ndarray:
        """Largest, mean of the three and eight largest, mean saving; shares beyond the thresholds; log of the number of windows."""
        top = np.sort(saved)[::-1]
        share = [(saved >= t).mean() for t in self.thresholds]
        many = (saved >= self.thresholds[-1]).sum()
        return np.array(
            [top[0], top[:3].mean(), top[:8].mean(), saved.mean(), *share, np.sqrt(share[-1]), np.log1p(many), np.log(len(saved))]
        )

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        x = (self.measure(self.savings(text.lower().encode("utf-8", "surrogatepass"))) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def _dictionaries(docs: list[tuple[bytes, int]], rng: random.Random) -> Model:
    """A model without calibration; without dictionaries where a class is missing."""
    toxic, ordinary = ([t for t, x in docs if x == y] for y in (1, 0))
    model = Model()
    if not toxic or not ordinary:
        return model
    marked = marked_grams(toxic, ordinary)
    found = Counter(p for t in toxic for p in passages(t, marked))
    repeated = [p for p, n in sorted(found.items()) for _ in range(min(n, REPEATS))]
    rng.shuffle(repeated)
    model.toxic = _dictionary([b"\0".join(repeated[i : i + 8]) for i in range(0, len(repeated), 8)], TOXIC_BYTES)
    prose = [w for t in ordinary for w in windows(t)]
    rng.shuffle(prose)
    model.ordinary = _dictionary(prose[:TRAINED], ORDINARY_BYTES)
    model.prepare()
    return model


def fit(rows: list[tuple[str, int, int]], seed: int = 5) -> Model:
    """From (text, toxic, half 0/1). Each half is measured with the dictionaries of the other, which is what the calibration is
    fitted to; the dictionaries that stay are those of both halves."""
    rng = random.Random(seed)
    docs = sorted({(t.lower().encode("utf-8", "surrogatepass"), x, c) for t, x, c in rows if t})
    model = _dictionaries([(t, x) for t, x, _ in docs], rng)
    if not model.ordinary:
        return model
    saved, y = [], []
    for half in (0, 1):
        other = _dictionaries([(t, v) for t, v, c in docs if c != half], rng)
        other = other if other.ordinary else model
        held = [(t, v) for t, v, c in docs if c == half]
        saved += [other.savings(t) for t, _ in held]
        y += [v for _, v in held]
    plain = np.concatenate([s for s, v in zip(saved, y, strict=True) if not v])
    # A byte more than those windows save.
    model.thresholds = tuple(max(1.0, float(np.quantile(plain, q, method="higher")) + 1) for q in BEYOND)
    x, y = np.array([model.measure(s) for s in saved]), np.array(y, float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + 1e-3 * w
        bend = (z * (p * (1 - p))[:, None]).T @ z / len(y) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    model.weights = w
    return model


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int, int]]:
    """The bounded sample of labelled rows outside the held-out fold. At most MAX_TOXIC + MAX_ORDINARY ids are broadcast, and as many sizes and texts collected."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(fold(F.col("doc_id")) != 1)
        .withColumn("half", (fold(F.col("doc_id")) == 2).cast("int"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC)
    chosen = chosen.union(known.where("toxic = 0").orderBy(*order).limit(MAX_ORDINARY))
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")
    rows = 2 * (MAX_TOXIC + MAX_ORDINARY)
    sizes = found.groupBy("place").agg(F.max("toxic").alias("toxic"), F.max(F.length("text")).alias("n")).orderBy("place").limit(rows).collect()
    left, places = {0: MAX_CHARS, 1: MAX_CHARS}, []
    for r in sizes:
        if r.n <= left[r.toxic]:
            left[r.toxic] -= r.n
            places.append((r.place,))
    if not places:
        return []
    picked = docs.sparkSession.createDataFrame(places, "place long")
    got = found.join(F.broadcast(picked), "place").select("place", "text", "toxic", "half").dropDuplicates(["place"]).collect()
    return [(r.text, int(r.toxic), int(r.half)) for r in sorted(got, key=lambda r: r.place)]


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"]
            )

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"), "text")
    scored = arrow(rows, _scorer(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(sample(docs, labels)))
