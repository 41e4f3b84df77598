"""Cross-entropy difference of two matched n-gram models.

The target model is counted on the documents labelled good (quality 1, toxic 0), the background model on all documents. Both share one
vocabulary, all lower-cased words of the corpus and one word for unseen ones. Both are bigram models, backed off to unigrams by the same
interpolation: P(b | a) = (n(ab) + D p(b)) / (n(a) + D), p(b) = (n(b) + S) / (N + S V). A document's score is its cross-entropy per token under
the background minus that under the target, in nats: higher means nearer to the target.

Every word and bigram of every whole document counts and scores, so the models grow with the corpus. They are never gathered in one place:

1. Words are counted, pre-aggregated in the tasks, and so are the bigrams that are frequent in some task's share.
2. The head, at most ``VOCABULARY`` words and ``BIGRAMS`` bigrams with the highest counts (about 12 MB), is counted exactly and broadcast. That is only a
   matter of speed: what is in the head is scored where the text is, and no key outside it has many documents.
3. All other bigrams meet by key. Tasks read texts in blocks and send each bucket of keys one row a block: the sorted keys, the documents' places in the
   block and their occurrences, as packed bytes. A bucket has every occurrence of its keys (a rare word's bigrams lie in one bucket, so that its own count
   is known there), counts them, and sends each block one row back: what its documents' log probabilities gain.
4. A block adds these up. Blocks and buckets grow with the root of the corpus, so that rows stay long and memory bounded.

Bigrams beyond the head are named by 64 bits or more of hashes, so that two of a billion share a name with probability below 0.05.

Defined cases: a null or empty text has 0 tokens and score 0; without target documents both models are the background and every
score is 0; repeated rows count and score one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import arrow, discard, materialize

VOCABULARY, BIGRAMS = 1 << 16, 1 << 18
#: Pseudo-counts of the backed-off distribution in a bigram's, and of each word in the unigrams.
DISCOUNT, SMOOTH = 5.0, 0.5
#: Words that a task remembers, tokens counted at once, and from which count among these a bigram may belong to the head.
REMEMBERED, COUNTED, PAIR_FROM = 400_000, 1_000_000, 4
#: Target ids up to this number are broadcast, about 60 MB; more are joined by shuffling.
BROADCAST_IDS = 2_000_000
#: Least and most tokens of a block of texts, and keys of a bucket.
BLOCK = (1_000_000, 32_000_000)
#: Bits of a first word's hash in the key of a bigram whose second word is in the head.
FIRST_BITS = 47
#: Stands for the first word where there is none.
START = 0

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(_U) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


@dataclass
class Model:
    """The head: id by word, counts of words, keys and counts of bigrams (column 0 background, 1 target), and both models' totals."""

    words: dict[str, int]
    unigrams: np.ndarray
    totals: np.ndarray
    all_target: bool = False
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    bigrams: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    def p(self) -> np.ndarray:
        return (self.unigrams + SMOOTH) / self.totals


class _Ids(dict):
    """Ids of words: of the head their numbers, of others a hash from 2^62."""

    def __init__(self, head: dict[str, int]) -> None:
        super().__init__(head)
        self.head = head

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.head) + REMEMBERED:
            self.clear(), self.update(self.head)
        h = blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self[word] = found = int.from_bytes(h, "big") >> 2 | 1 << 62
        return found


class _Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


def _tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _blocks(batches: Iterator[pa.RecordBatch], ids: dict[str, int], tokens: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Of about so many tokens each: document ids, target flags, tokens per text, and all tokens' ids."""
    names, flags, sizes, parts, held = [], [], [], [], 0
    for batch in batches:
        for name, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            part = np.array([ids[w] for w in _tokens(text.as_py())], np.int64)
            names.append(name), flags.append(flag), sizes.append(len(part)), parts.append(part)
            held += len(part)
            if held >= tokens or len(names) >= 1 << 20:
                yield names, np.array(flags, bool), np.array(sizes, np.int64), np.concatenate(parts)
                names, flags, sizes, parts, held = [], [], [], [], 0
    if names:
        yield names, np.array(flags, bool), np.array(sizes, np.int64), np.concatenate(parts)


def _firsts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which token is a text's first, and which its last."""
    first, last = np.zeros(sizes.sum(), bool), np.zeros(sizes.sum(), bool)
    ends = np.cumsum(sizes)[sizes > 0]
    last[ends - 1], first[ends - sizes[sizes > 0]] = True, True
    return first, last


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, and pairs of words that are frequent in this share of the texts: word, next (null for a word alone), n, target."""
    numbers = _Numbers()
    for _, flags, sizes, ids in _blocks(batches, numbers, COUNTED):
        good = np.repeat(flags, sizes)
        names = list(numbers)
        n, t = np.bincount(ids, minlength=len(names)), np.bincount(ids, weights=good, minlength=len(names))
        seen = np.flatnonzero(n)
        first, _ = _firsts(sizes)
        pair, m = np.unique((ids[:-1] << 32 | ids[1:])[~first[1:]], return_counts=True)
        pair, m = pair[m >= PAIR_FROM], m[m >= PAIR_FROM]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[k] for k in seen] + [names[k] for k in pair >> 32], pa.string()),
                pa.array([None] * len(seen) + [names[k] for k in pair & 0xFFFFFFFF], pa.string()),
                pa.array(np.concatenate((n[seen], m)), pa.int64()),
                pa.array(np.concatenate((t[seen], 0 * m)).astype(np.int64), pa.int64()),
            ],
            ["word", "next", "n", "target"],
        )
        if len(numbers) > REMEMBERED:
            numbers.clear()


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of bigrams whose second word is in the head."""
    return b.astype(_U) << _U(FIRST_BITS) | _mix(a) >> _U(64 - FIRST_BITS)


def _entries(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc) in order, with how often each occurs and where it occurs first; docs ascend as given."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    start = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order[start], np.diff(np.append(start, len(k))), start


def _found(model: Model, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the head's bigrams, and whether it is there."""
    if not len(model.keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    return at, model.keys[at] == key


def _head_counts(shared):
    """Exact counts of the head's bigrams: at (their place), n, target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n, t = np.zeros(len(model.keys), np.int64), np.zeros(len(model.keys), np.int64)
        for _, flags, sizes, ids in _blocks(batches, _Ids(model.words), COUNTED):
            good = np.repeat(flags, sizes)[1:]
            first, _ = _firsts(sizes)
            pair = ~first[1:] & (ids[:-1] < VOCABULARY) & (ids[1:] < VOCABULARY)
            at, hit = _found(model, _keys(ids[:-1][pair], ids[1:][pair]))
            n += np.bincount(at[hit], minlength=len(n))
            t += np.bincount(at[hit], weights=good[pair][hit], minlength=len(n)).astype(np.int64)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64()), pa.array(t[seen], pa.int64())], ["at", "n", "target"])

    return run


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays as bytes, the bytes of equal weight together, compressed."""
    import zstandard

    sizes = np.array([len(c) for c in columns], "<u4").tobytes()
    return zstandard.compress(sizes + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), 1)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw, at, out = np.frombuffer(zstandard.decompress(data), np.uint8), 4 * len(kinds), []
    for n, kind in zip(raw[:at].view("<u4").tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _steps(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=_U(0))


#: Columns of a bucket's row: of bigrams with a second word in the head key, doc and times; of others second word, first, doc, times and followed. A doc is twice
#: its place in the block, and one more if it is a target. Of a row back: doc and what its two log probabilities gain. Of a block's own: ids, whether there is one, tokens, logs.
TO_BUCKET = (np.uint64, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
BACK = (np.uint32, np.float32, np.float32)
OWN = (np.int64, np.uint8, np.int64, np.float64, np.float64)
ROW = "bucket long, block long, own boolean, payload binary"
NAMES = ["bucket", "block", "own", "payload"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], NAMES)


def _measured(shared, buckets: int, tokens: int):
    """Per block its own row with what the head says, and a row for each bucket with the bigrams beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        p, context = np.log(model.p()), np.log(model.unigrams + DISCOUNT)
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        for names, flags, sizes, ids in _blocks(batches, _Ids(model.words), tokens):
            flags = flags | model.all_target
            docs = len(names)
            doc = np.repeat(np.arange(docs), sizes)
            first, last = _firsts(sizes)
            total = lambda at, values: np.stack([np.bincount(doc[at], weights=values[:, k], minlength=docs) for k in (0, 1)], axis=1)  # noqa: B023, E731
            head = np.flatnonzero(ids < VOCABULARY)
            log = total(head, p[ids[head]]) + (np.maximum(sizes - 1, 0) * np.log(DISCOUNT))[:, None]
            inner = head[~last[head]]
            log -= total(inner, context[ids[inner]])
            pair = np.flatnonzero(~first & (ids < VOCABULARY))
            key = _keys(ids[pair - 1], ids[pair])
            at, times, _ = _entries(key, doc[pair])
            key, at = key[at], pair[at]
            place, hit = _found(model, key)
            n = np.where(hit[:, None], model.bigrams[place] if len(model.keys) else 0.0, times[:, None] * np.stack((np.ones(len(at)), flags[doc[at]]), axis=1))
            log += total(at, times[:, None] * np.log1p(n / (DISCOUNT * np.exp(p[ids[at]]))))
            key, times, at = key[~hit], times[~hit], at[~hit]
            code = lambda x: (2 * doc[x] + flags[doc[x]]).astype(np.uint32)  # noqa: B023, E731
            tail = np.flatnonzero(ids >= VOCABULARY)
            before = np.where(first[tail], START, (_mix(ids[tail - 1]) >> _U(33)).astype(np.int64) + 1)
            # The rare words' bigrams by second word, then first, then document.
            order = np.lexsort((doc[tail], before, ids[tail]))
            s, a, d = ids[tail][order], before[order], doc[tail][order]
            new = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (a[1:] != a[:-1]) | (d[1:] != d[:-1]))) if len(s) else np.zeros(0, np.int64)
            many = np.diff(np.append(new, len(s)))
            followed = np.add.reduceat((~last[tail][order]).astype(np.int64), new) if len(new) else many
            s, a = s[new].astype(_U), a[new]
            code_tail = code(tail[order][new])
            code_head = code(at)
            to, to_tail = (_mix(key) % _U(buckets)).astype(np.int64), (s % _U(buckets)).astype(np.int64)
            by, by_tail = np.argsort(to, kind="stable"), np.argsort(to_tail, kind="stable")
            ends, ends_tail = np.searchsorted(to[by], np.arange(buckets + 1)), np.searchsorted(to_tail[by_tail], np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                h, t = by[ends[k] : ends[k + 1]], by_tail[ends_tail[k] : ends_tail[k + 1]]
                if len(h) or len(t):
                    u4 = lambda x: x.astype(np.uint32)
                    out.append((k, block, False, _packed(_steps(key[h]), code_head[h], u4(times[h]), _steps(s[t]), u4(a[t]), code_tail[t], u4(many[t]), u4(followed[t]))))
            known = np.array([x is not None for x in names], np.uint8)
            own = _packed(np.array([x or 0 for x in names], np.int64), known, sizes, log[:, 0], log[:, 1])
            out.append((block % buckets, block, True, own))
            yield _rows(out)
            block += 1

    return run


def _bucket(rows: list[tuple[int, bytes]], model: Model) -> Iterator[tuple[int, bytes]]:
    """What every block's documents gain by one bucket's bigrams."""
    blocks = sorted({b for b, _ in rows})
    number = {b: k for k, b in enumerate(blocks)}
    parts = []
    for b, data in rows:
        c = _unpacked(data, *TO_BUCKET)
        up = np.int64(number[b]) << 33
        parts.append((np.cumsum(c[0], dtype=_U), c[1].astype(np.int64) | up, c[2], np.cumsum(c[3], dtype=_U), c[4], c[5].astype(np.int64) | up, c[6], c[7]))
    key, doc, times, second, first, doc2, times2, followed = (np.concatenate(x) for x in zip(*parts, strict=True))
    p = model.p()
    both = lambda where, m, flag, size: np.stack((np.bincount(where, weights=m, minlength=size), np.bincount(where, weights=m * flag, minlength=size)), axis=1)
    flag = doc & 1
    u, where = np.unique(key, return_inverse=True)
    n = both(where, times, flag, len(u))[where]
    mine = times[:, None] * np.stack((np.ones(len(flag)), flag), axis=1)
    more = np.flatnonzero((n != mine).any(axis=1))
    unit = DISCOUNT * p[(key[more] >> _U(FIRST_BITS)).astype(np.int64)]
    gain = times[more, None] * (np.log1p(n[more] / unit) - np.log1p(mine[more] / unit))
    # The rare words: their own counts, then those of their bigrams.
    flag2 = doc2 & 1
    u, word = np.unique(second, return_inverse=True)
    whole = both(word, times2, flag2, len(u))[word]
    u, where = np.unique(word.astype(np.int64) << 32 | first, return_inverse=True)
    n2 = both(where, times2, flag2, len(u))[where]
    share = (whole + SMOOTH) / model.totals
    gain2 = times2[:, None] * np.log(share) - followed[:, None] * np.log(whole + DISCOUNT)
    gain2 += np.where(first[:, None] == START, 0.0, times2[:, None] * np.log1p(n2 / (DISCOUNT * share)))
    docs, where = np.unique(np.concatenate((doc[more], doc2)) >> 1, return_inverse=True)
    sums = [np.bincount(where, weights=np.concatenate((gain[:, k], gain2[:, k])), minlength=len(docs)).astype(np.float32) for k in (0, 1)]
    of = docs >> 32
    for k, b in enumerate(blocks):
        lo, hi = np.searchsorted(of, (k, k + 1))
        if lo < hi:
            yield b, _packed((docs[lo:hi] & 0xFFFFFFFF).astype(np.uint32), sums[0][lo:hi], sums[1][lo:hi])


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[int, list[tuple[int, bool, bytes]]]]:
    """Rows of sorted batches, one group in memory at a time."""
    held: list[tuple[int, bool, bytes]] = []
    now = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[by] != now and held:
                yield now, held
                held = []
            now = row[by]
            held.append((row[1], row[2], row[3]))
    if held:
        yield now, held


def _exchanged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for bucket, rows in _grouped(batches, 0):
            out = [(bucket, b, True, data) for b, own, data in rows if own]
            sent = [(b, data) for b, own, data in rows if not own]
            if sent:
                out += [(bucket, b, False, data) for b, data in _bucket(sent, model)]
            yield _rows(out)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _grouped(batches, 1):
        (names, known, sizes, *log) = _unpacked(next(data for _, own, data in rows if own), *OWN)
        log = np.stack(log)
        for _, own, data in rows:
            if not own:
                doc, *gain = _unpacked(data, *BACK)
                log[:, doc] += gain
        per = np.where(sizes > 0, -log / np.maximum(sizes, 1), 0.0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, mask=known == 0), pa.array(sizes), pa.array(per[0]), pa.array(per[1])], ["doc_id", "n_tokens", "background", "target"]
        )


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows with n beyond a level (eighths of powers of two) that at most ``limit`` rows reach, without sorting them."""
    level = F.floor(F.log2("n") * 8).cast("int")
    left, least = limit, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    return counts.where(F.lit(False) if least is None else level >= least)


def _marked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, target, text. Ids up to ``BROADCAST_IDS`` are broadcast; beyond, texts are joined once and written, in a fixed order."""
    good = targets.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(good) if few else good.hint("merge"), "doc_id", "left")
    out = out.select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    return out if few else materialize(out, "lm-marked")


def fit(marked: DataFrame) -> tuple[Model, int]:
    """The head, and the number of tokens, from (doc_id, target, text)."""
    counted = arrow(marked, _counts, "word string, next string, n long, target long")
    counted = materialize(counted.groupBy("word", "next").agg(F.sum("n").alias("n"), F.sum("target").alias("target")), "lm-words")
    alone = counted.where("next is null")
    total = alone.agg(F.sum("n"), F.sum("target"), F.count("n")).first()
    rows = most_frequent(alone, VOCABULARY).orderBy("word").toPandas()
    words = {w: k for k, w in enumerate(rows["word"])}
    unigrams = np.zeros((VOCABULARY, 2))
    unigrams[: len(rows)] = rows[["n", "target"]].to_numpy(float).reshape(-1, 2)
    totals = np.array([total[0] or 0, total[1] or 0], float)
    if not total[1]:
        unigrams[:, 1], totals[1] = unigrams[:, 0], totals[0]
    # One word more for the unseen ones.
    model = Model(words, unigrams, totals + SMOOTH * (total[2] + 1), not total[1])
    pairs = most_frequent(counted.where("next is not null"), BIGRAMS).select("word", "next").toPandas()
    a, b = (pairs[c].map(words) for c in ("word", "next"))
    here = (a.notna() & b.notna()).to_numpy(bool)
    model.keys = np.unique(_keys(a[here].to_numpy(np.int64), b[here].to_numpy(np.int64)))
    model.bigrams = np.zeros((len(model.keys), 2))
    if len(model.keys):
        shared = marked.sparkSession.sparkContext.broadcast(model)
        found = arrow(marked, _head_counts(shared), "at long, n long, target long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("target").alias("target")).toPandas()
        model.bigrams[found["at"]] = found[["n", "target"]].to_numpy(float)
        if model.all_target:
            model.bigrams[:, 1] = model.bigrams[:, 0]
        shared.unpersist()
    discard(counted)
    return model, int(total[0] or 0)


def score_documents(docs: DataFrame, targets: DataFrame, block: int | None = None) -> DataFrame:
    """doc_id, n_tokens, the two cross-entropies and score of every row; ``targets`` has the ids of the target documents, column doc_id."""
    marked = _marked(docs, targets)
    model, tokens = fit(marked)
    block = block or min(BLOCK[1], max(BLOCK[0], isqrt(200 * tokens)))
    buckets = 1 + tokens // block
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = arrow(marked, _measured(shared, buckets, block), ROW)
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    back = arrow(met, _exchanged(shared), ROW).repartition(buckets, "block").sortWithinPartitions("block")
    scored = arrow(back, _added, "doc_id long, n_tokens long, background double, target double")
    return scored.withColumn("score", F.col("background") - F.col("target"))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, labels.where("quality = 1 and coalesce(toxic, 0) = 0"))
