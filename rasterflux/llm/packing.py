"""Vector bin packing of tokenised documents into training sequences.

Every piece has three sizes: tokens, one segment, and loss-bearing tokens; a sequence limits all three at once. Bins are filled one at a
time: among the pieces that fit, the one with the largest dot product of its sizes, as shares of the limits and scaled to unit length, and the bin's free
room goes in, so that a piece has the shape of the room left. When none fits, and for the last segment, the largest piece is cut to fill the bin.
Each task packs its own rows in windows and carries an unfinished bin into the next window, so nothing is shuffled and memory is one
window. A bin that the segments or the loss have filled before the tokens, and a task's last one, is cut into sequences whose lengths are powers of two,
which need no padding; one that lacks at most ``Limits.padding`` tokens is left whole.

``op9`` limits a sequence to 4,096 tokens and 16 segments. A document's first id bears no loss, as nothing predicts it; so in plain text the loss limit
of 4,096 never binds, and it is for instruction data, whose prompts bear none (``loss_start``).

Defined cases: a null or empty text is the end id alone; a text longer than a sequence is cut into full sequences and a rest; repeated rows are
packed one by one; an empty table gives no rows; extra columns are ignored. ``sequence_id`` holds the task in its upper bits, so
ids are unique but not gapless.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import arrow

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Entries kept in a worker's word caches before they are started anew.
CACHE_WORDS = 300_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 16
    loss_tokens: int = 4096
    #: Most padding of a sequence.
    padding: int = 64
    #: Pieces packed together; the heuristic looks at all of them.
    window: int = 1500


class WordTokenizer:
    """Ids of whole texts for a vocabulary that drops white space, by the parts between white space.

    A text's ids are those of its parts in order, so parts are looked up in a bounded cache. Plain parts (Latin letters, then marks)
    go to the merge model directly; all others through the whole tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?:;%$#&*|]*)")
    #: Characters that Python takes for white space and the tokenizer does not.
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole: Tokenizer = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.byte_chars = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_chars)
            ids = np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if (m := self.PLAIN.fullmatch(part)) and len(part) < 64:
            letters, marks = m.groups()
            return self._word(letters.lower()) + (self._word(marks) if marks else b"")
        return self._whole(part)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.ODD.search(text):
            return self._whole(text)
        parts, known = text.split(), self.parts
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) >= CACHE_WORDS:
            known.clear()
        for p in parts:
            if p not in known:
                known[p] = self._part(p)
        return b"".join([known[p] for p in parts])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


@dataclass(slots=True)
class Piece:
    doc: int | None
    ids: bytes
    start: int
    end: int
    loss_start: int

    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.loss_start))

    def fitting(self, tokens: int, loss: int) -> int:
        """How many tokens from the start fit the given room."""
        free = max(0, min(self.end, self.loss_start) - self.start)
        return min(self.end - self.start, tokens, free + loss)


def cut_long(piece: Piece, limits: Limits) -> Iterator[Piece]:
    """Parts that fit an empty sequence each."""
    while piece.start < piece.end:
        n = piece.fitting(limits.tokens, limits.loss_tokens)
        yield Piece(piece.doc, piece.ids, piece.start, piece.start + n, piece.loss_start)
        piece.start += n


def pack(pieces: list[Piece], limits: Limits) -> list[list[Piece]]:
    """Bins of pieces; every bin but the last is full in one dimension at least. Pieces may be cut."""
    pieces = sorted(pieces, key=lambda p: (p.start - p.end, p.doc if p.doc is not None else -1, p.start))
    n = len(pieces)
    room = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    sizes = np.array([[p.end - p.start, 1, p.loss()] for p in pieces], float).reshape(n, 3)
    shape = lambda x: (y := x / room) / np.maximum(np.linalg.norm(y, axis=-1, keepdims=True), 1e-300)
    scaled = shape(sizes)
    live = np.arange(n)
    bins: list[list[Piece]] = []
    while len(live):
        free, content = room.copy(), []
        while len(live):
            fits = (sizes[live] <= free).all(axis=1)
            if free[1] > 1 and fits.any():
                score = scaled[live] @ (free / room)
                score[~fits] = -1
                k = int(score.argmax())
                content.append(pieces[live[k]])
                free -= sizes[live[k]]
                live = np.delete(live, k)
                continue
            k = int(sizes[live, 0].argmax())
            p = pieces[live[k]]
            if free[1] >= 1 and (m := p.fitting(int(free[0]), int(free[2]))) > 0:
                content.append(Piece(p.doc, p.ids, p.start, p.start + m, p.loss_start))
                p.start += m
                sizes[live[k]] = p.end - p.start, 1, p.loss()
                scaled[live[k]] = shape(sizes[live[k]])
            break
        bins.append(content)
    return bins


def unpadded(content: list[Piece], limits: Limits) -> Iterator[list[Piece]]:
    """The bin as one sequence, or as several with lengths of powers of two where one would be padded by more than the limit."""
    total = sum(p.end - p.start for p in content)
    if limits.tokens - total <= limits.padding or total & (total - 1) == 0:
        yield content
        return
    pieces = iter(content)
    p = next(pieces)
    at = p.start
    for k in reversed(range(total.bit_length())):
        room = total & 1 << k
        part: list[Piece] = []
        while room:
            n = min(room, p.end - at)
            part.append(Piece(p.doc, p.ids, at, at + n, p.loss_start))
            room, at = room - n, at + n
            if at == p.end and (p := next(pieces, None)):
                at = p.start
        if part:
            yield part


def _packer(path: str, end_id: int, limits: Limits, has_loss: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        base, made = (task.partitionId() if task else 0) << 32, 0
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        waiting: list[Piece] = []
        out: list[tuple] = []

        def emit(content: list[Piece]) -> None:
            nonlocal made
            for sequence in unpadded(content, limits):
                offset = 0
                for k, p in enumerate(sequence):
                    crc = zlib.crc32(memoryview(p.ids)[4 * p.start : 4 * p.end])
                    out.append((p.doc, p.start, p.end - p.start, crc, len(p.ids) // 4, base + made, offset, p.loss(), k))
                    offset += p.end - p.start
                made += 1

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(NAMES)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)
            out.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            starts = batch.column(2).to_pylist() if has_loss else None
            for k, doc in enumerate(ids):
                data = tok.ids(texts[k].as_py() or "") + end
                whole = Piece(doc, data, 0, len(data) // 4, (starts[k] or 0) if starts else 1)
                for p in cut_long(whole, limits):
                    if p.end - p.start == limits.tokens:
                        emit([p])
                    else:
                        waiting.append(p)
                if len(waiting) >= limits.window:
                    *full, waiting = pack(waiting, limits)
                    for content in full:
                        emit(content)
            yield rows()
        for content in pack(waiting, limits):
            emit(content)
        yield rows()

    return run


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), loss_start: str | None = None
) -> DataFrame:
    """One row per piece. ``loss_start`` names a column with the index of a document's first loss-bearing id (default 1: all but the first)."""
    cols = [F.col("doc_id").cast("long"), F.col("text")] + ([F.col(loss_start).cast("long")] if loss_start else [])
    return arrow(docs.select(*cols), _packer(tokenizer_path, end_id, limits, loss_start is not None), SCHEMA)


def default_tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, default_tokenizer_path())
