"""Quality classifier from weak labels.

Heuristic labellers vote junk, good or nothing on every document. The votes' joint counts over all documents (one row per vote pattern, pre-aggregated
in the tasks) are enough for expectation-maximisation, which estimates each labeller's accuracies on both classes and the share of junk without any
true label. The posterior of a document's pattern is its soft label; a hashed linear scorer learns the soft labels of a bounded sample of documents
(the ``MAX_SAMPLE`` distinct ones, by id and text, that come first in the order of a hash; whole texts, measured in the tasks) and then scores every whole text.

Defined cases: on a null or empty text no labeller votes, and the scorer sees only its empty-text feature; the score is then the share of good documents
as the scorer knows it. Repeated rows get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import arrow

MAX_SAMPLE = 6000
#: Hash buckets of the scorer.
DIMS = 1 << 13
KEEP_FROM = 0.5

#: Byte classes of the shape features: 0 blank, 1 line end, 2 lower, 3 upper, 4 digit, 5 other letters, 6 stop, 7 comma, then marks.
_MARKS = "!?#*$%&|<>"
_CLASS = np.full(256, 8, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 5
_CLASS[ord(".")], _CLASS[ord(",")] = 6, 7
for _k, _c in enumerate("!#*$%&|"):
    _CLASS[ord(_c)] = 9 + _k

LABELLERS = ("symbols", "symbol_words", "upper_letters", "upper_words", "shouting", "few_distinct", "stuttering", "same_lines", "prose")
#: Votes.
JUNK, NONE, GOOD = 0, 1, 2


@dataclass
class Facts:
    """What labellers and features need of a text, from one pass."""

    n: int
    classes: np.ndarray
    counts: np.ndarray
    distinct: float
    stutter: float
    same_lines: float
    upper_words: float
    symbol_words: float
    shouting: float
    stops: float


def facts(text: str | None) -> Facts:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    classes = _CLASS[data]
    counts = np.bincount(classes, minlength=16)
    words = (text or "").split()
    n = len(words)
    many = max(1, n)
    # A word's last byte and first two bytes, from where blanks begin and end.
    blank = classes < 2
    last = classes[np.flatnonzero(~blank & np.append(blank[1:], True))] if n else np.zeros(0, np.uint8)
    first = np.flatnonzero(~blank & np.append(True, blank[:-1])) if n else np.zeros(0, np.int64)
    second = classes[np.minimum(first + 1, len(classes) - 1)] if n else np.zeros(0, np.uint8)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return Facts(
        n,
        classes,
        counts,
        len(set(words)) / many,
        sum(map(operator.eq, words, words[1:])) / many,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float((second == 3).sum()) / many,
        float(((last >= 10) & (last <= 15)).sum()) / many,
        float((last == 9).sum()) / many,
        float((last == 6).sum()) / many,
    )


def votes(f: Facts) -> list[int]:
    """One vote per labeller; each abstains where it has little to go on."""
    if not f.n:
        return [NONE] * len(LABELLERS)
    letters = max(1, int(f.counts[[2, 3, 5]].sum()))
    marks = int(f.counts[10:].sum()) / max(1, int(f.counts[2:].sum()))

    def by(value: float, junk: float, good: float, enough: bool = True) -> int:
        if not enough:
            return NONE
        return JUNK if value > junk else GOOD if value < good else NONE

    return [
        by(marks, 0.05, 0.01),
        by(f.symbol_words, 0.3, 0.05),
        by(f.counts[3] / letters, 0.5, 0.15, letters >= 20),
        by(f.upper_words, 0.4, 0.1, f.n >= 5),
        by(f.shouting, 0.3, 0.05, f.n >= 5),
        by(1 - f.distinct, 0.75, 0.5, f.n >= 40),
        by(f.stutter, 0.3, 0.03, f.n >= 10),
        by(f.same_lines, 0.3, 0.05, f.counts[1] >= 3),
        GOOD if 0.02 <= f.stops <= 0.5 and f.n >= 20 else NONE,
    ]


def pattern(v: list[int]) -> int:
    code = 0
    for x in v:
        code = 3 * code + x
    return code


def unpattern(codes: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), len(LABELLERS)), np.int64)
    for k in reversed(range(len(LABELLERS))):
        out[:, k], codes = codes % 3, codes // 3
    return out


@dataclass
class LabelModel:
    """P(good) and, per class and labeller, the accuracy: the probability of each vote where it votes.

    An abstention says nothing, else the model would learn to tell short texts from long ones instead.
    """

    good: float
    tables: np.ndarray  # (class, labeller, vote), 1 for an abstention; class 0 is junk

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        log = np.log(np.array([1 - self.good, self.good]))[:, None] + sum(
            np.log(self.tables[:, k, :])[:, v[:, k]] for k in range(v.shape[1])
        )
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def expectation_maximisation(v: np.ndarray, n: np.ndarray, steps: int = 200) -> LabelModel:
    """From distinct vote rows and their counts. It starts from: any junk vote means junk, probably."""
    post = np.where((v == JUNK).any(axis=1), 0.05, 0.95)
    model = LabelModel(0.5, np.ones((2, v.shape[1], 3)))
    for _ in range(steps):
        before = post
        for c, weight in enumerate((n * (1 - post), n * post)):
            for k in range(v.shape[1]):
                seen = np.bincount(v[:, k], weights=weight, minlength=3) + 0.1
                model.tables[c, k] = seen / (seen[JUNK] + seen[GOOD])
                model.tables[c, k, NONE] = 1.0
        model.good = float(np.clip((n * post).sum() / max(1, n.sum()), 0.01, 0.99))
        post = model.posterior(v)
        if np.abs(post - before).max(initial=0) < 1e-6:
            break
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[int] = Counter()
    for batch in batches:
        seen.update(pattern(votes(facts(t.as_py()))) for t in batch.column(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"]
    )


def label_model(docs: DataFrame) -> LabelModel:
    """Fitted to the votes on all documents; at most 3^9 patterns come to the driver."""
    rows = arrow(docs.select("text"), _count, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()
    codes = np.array(sorted((r[0], r[1]) for r in rows), np.int64).reshape(-1, 2)
    return expectation_maximisation(unpattern(codes[:, 0]), codes[:, 1].astype(float))


def _bucket(token: str) -> int:
    return 4096 + zlib.crc32(token.encode()) % (DIMS - 4096)


def vector(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets and values: square roots of the shares of shape trigrams, and indicators of rounded measurements."""
    c = f.classes.astype(np.int64)
    index, value = np.zeros(0, np.int64), np.zeros(0)
    if len(c) >= 3:
        seen = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=4096)
        index = np.flatnonzero(seen)
        value = np.sqrt(seen[index] / (len(c) - 2))
    level = lambda x: int(min(x, 1.0) * 8)
    tokens = ["empty"] if not f.n else [
        f"stutter {level(f.stutter)}",
        f"lines {level(f.same_lines)}",
        f"distinct {level(f.distinct)} {f.n >= 40}",
        f"upper {level(f.upper_words)}",
        f"marks {level(f.symbol_words)}",
        f"shout {level(f.shouting)}",
        f"stops {level(f.stops)}",
    ]
    return np.concatenate((index, [_bucket(t) for t in tokens])).astype(np.int64), np.concatenate((value, [0.5] * len(tokens)))


@dataclass
class Scorer:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, np.float32))
    bias: float = 0.0

    def score(self, text: str | None) -> float:
        i, x = vector(facts(text))
        return float(1 / (1 + np.exp(-np.clip(self.weights[i] @ x + self.bias, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: LabelModel, epochs: int = 12, rate: float = 0.5, l2: float = 1e-5) -> Scorer:
    """Logistic regression on posterior labels by adaptive gradient steps in a fixed order, from buckets, values and vote pattern of each document."""
    if not rows:
        return Scorer()
    y = labels.posterior(unpattern(np.array([code for _, _, code in rows], np.int64)))
    # Both classes weigh the same, so the rarer is learnt as well.
    share = float(np.clip(y.mean(), 0.02, 0.98))
    w, b, past, past_b = np.zeros(DIMS), 0.0, np.full(DIMS, 1e-6), 1e-6
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x, _ = rows[k]
            p = 1 / (1 + np.exp(-np.clip(w[i] @ x + b, -30, 30)))
            weight = y[k] * 0.5 / share + (1 - y[k]) * 0.5 / (1 - share)
            err = (p - y[k]) * weight
            g = err * x + l2 * w[i]
            past[i] += g * g
            w[i] -= rate * g / np.sqrt(past[i])
            past_b += err * err
            b -= rate * err / past_b**0.5
    return Scorer(w.astype(np.float32), float(b))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [facts(t.as_py()) for t in batch.column(1)]
        rows = [vector(f) for f in seen]
        arrays = [batch.column(0), pa.array([i for i, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.float64())), pa.array([pattern(votes(f)) for f in seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["place", "buckets", "values", "pattern"])


def sample(docs: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """What the scorer learns from, in a fixed order. Only hashes are ranked and only measurements come to the driver."""
    placed = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("place"), "text")
    last = placed.select("place").distinct().orderBy("place").limit(MAX_SAMPLE).agg(F.max("place")).first()[0]
    if last is None:
        return []
    found = arrow(placed.where(F.col("place") <= last), _measured, "place long, buckets array<bigint>, values array<double>, pattern long")
    rows = found.dropDuplicates(["place"]).collect()
    return [(np.array(r.buckets, np.int64), np.array(r["values"]), r.pattern) for r in sorted(rows, key=lambda r: r.place)]


def fit(docs: DataFrame) -> Scorer:
    return train(sample(docs), label_model(docs))


def _scorer(scorer: Scorer, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in batch.column(columns)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(columns)] + [scores], [f"c{k}" for k in range(columns)] + ["score"])

    return run


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score (P(good)) and kept of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = arrow(docs.select("doc_id", "text"), _scorer(scorer, 1), f"doc_id {kind}, score double")
    return scored.withColumn("kept", F.col("score") >= KEEP_FROM)


def op8(docs: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    row = docs.select(F.struct(*docs.columns).alias("c0"), "text")
    kind = row.schema["c0"].dataType.simpleString()
    scored = arrow(row, _scorer(fit(docs), 1), f"c0 {kind}, score double")
    return scored.where(F.col("score") >= KEEP_FROM).select("c0.*")
