"""Packing documents into fixed-length training sequences by vector bin packing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import BYTE_LEVEL
from .common import texts, tokenizer_path
from .pretokens import spaced_units

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: ids, pieces, and ids that bear loss.

    ``window`` is how many waiting pieces a task chooses from; it bounds memory, and every piece is placed.
    """

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    window: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss, self.window) < 1:
            raise ValueError("every limit must be at least 1")


#: Characters of a unit that a worker keeps, and of how many new units one is encoded twice.
LONGEST, CHECKED = 64, 64


class ByteBpe:
    """Ids as the library gives them. Units that occur again come from a cache, which starts anew where it would pass ``cached`` entries.

    New units of a group of texts are encoded together, a line each: a line end is a token of its own and stands in no
    unit, so ids are cut there. That goes by the same vocabulary's rank file, which takes half the time; one unit in CHECKED
    goes through the library too, and a difference fails the job. Texts that aren't made of units go through the library whole.
    Units of more than LONGEST characters aren't kept.
    """

    def __init__(self, path: str, ranks_path: str, cached: int = 800_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library, self.cached = Tokenizer.from_file(path).encode_batch_fast, cached
        line_end = self.ids("\n")
        self.line_end, self.start = line_end[0], {"\n": line_end.tobytes()}
        self.units = dict(self.start)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, units: list[str]) -> None:
        ids = np.asarray(self.fast("\n".join(units)), "<u4")
        cuts = 4 * np.nonzero(ids == self.line_end)[0]
        if len(cuts) != len(units) - 1:
            raise ValueError("this vocabulary does not keep line ends apart")
        raw, begin, end = ids.tobytes(), [0, *(cuts + 4).tolist()], [*cuts.tolist(), 4 * len(ids)]
        self.units.update(zip(units, map(raw.__getitem__, map(slice, begin, end)), strict=True))
        some = units[::CHECKED]
        if self.ids("\n".join(some)).tobytes() != self.start["\n"].join(self.units[u] for u in some):
            raise ValueError("the rank file is not of the library's vocabulary")

    def many(self, texts: list[str], group: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text, unsigned little-endian 32-bit; about ``group`` characters are cut into units at a time."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size == 0 or size + len(texts[to]) <= group):
                size, to = size + len(texts[to]) + 1, to + 1
            cut = [spaced_units(t) for t in texts[at:to]]
            every = set().union(*(u for u in cut if u))
            new = every.difference(self.units)
            if len(self.units) + len(new) > self.cached:
                self.units = dict(self.start)
                new = every.difference(self.units)
            long = [u for u in new if len(u) > LONGEST]
            short = list(new.difference(long) if long else new)
            for k in range(0, len(short), 20_000):
                self._learn(short[k : k + 20_000])
            self.units.update((u, self.ids(u).tobytes()) for u in long)
            get = self.units.__getitem__
            for t, units in zip(texts[at:to], cut, strict=True):
                yield self.ids(t).tobytes() if units is None else b"".join(map(get, units))
            for u in long:
                del self.units[u]
            at = to

    def __call__(self, text: str) -> bytes:
        return b"".join(self.many([text]))


_ENCODERS: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, ranks_path: str) -> ByteBpe:
    """One encoder for each worker process."""
    if (path, ranks_path) not in _ENCODERS:
        _ENCODERS[path, ranks_path] = ByteBpe(path, ranks_path)
    return _ENCODERS[path, ranks_path]


class Packer:
    """Fills one sequence after the other from a window of waiting pieces.

    The next piece of a sequence is the one that fits in every dimension and whose demand has the
    greatest dot product with what is left, each dimension as a share of its limit. Where none fits,
    the largest waiting piece is cut to what is left, so only a sequence out of segments, or the
    task's last, is padded.
    """

    def __init__(self, limits: Limits, first_id: int) -> None:
        self.limits, self.next_id = limits, first_id
        self.waiting: list[tuple[int, int, int, bytes, int]] = []  # doc_id, start, prompt, ids, doc_tokens
        self.demand = np.zeros((limits.window + 1, 3))
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.out: dict[str, list] = {f.name: [] for f in PIECES}

    def _demand(self, start: int, prompt: int, ids: bytes) -> tuple[int, int, int]:
        n = len(ids) // 4
        return n, 1, max(0, start + n - max(start, prompt))

    def _emit(self, piece: tuple[int, int, int, bytes, int], loss: int, offset: int) -> None:
        doc_id, start, _, ids, doc_tokens = piece
        for name, value in zip(self.out, (doc_id, start, len(ids) // 4, ids, doc_tokens, loss, self.next_id, offset), strict=True):
            self.out[name].append(value)

    def add(self, doc_id: int, ids: bytes, prompt: int) -> None:
        """Stretches that fill a sequence go out at once; the rest waits."""
        total, at, lim = len(ids) // 4, 0, self.limits
        while True:
            n, _, loss = self._demand(at, prompt, ids[4 * at :])
            if n < lim.tokens and loss < lim.loss:
                break
            n = self._fit(at, prompt, n, lim.tokens, lim.loss)
            self._emit((doc_id, at, prompt, ids[4 * at : 4 * (at + n)], total), self._demand(at, prompt, ids[4 * at : 4 * (at + n)])[2], 0)
            self.next_id += 1
            at += n
        if n:
            self._wait((doc_id, at, prompt, ids[4 * at :], total))
            while len(self.waiting) >= lim.window:
                self.fill()

    def _wait(self, piece: tuple[int, int, int, bytes, int]) -> None:
        self.demand[len(self.waiting)] = np.divide(self._demand(piece[1], piece[2], piece[3]), self.scale)
        self.waiting.append(piece)

    def _take(self, i: int) -> tuple[int, int, int, bytes, int]:
        piece, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return piece

    @staticmethod
    def _fit(start: int, prompt: int, n: int, tokens: int, loss: int) -> int:
        """Longest stretch from ``start`` within both limits."""
        return min(n, tokens, max(0, prompt - start) + loss)

    def fill(self) -> None:
        lim, left, offset = self.limits, np.ones(3), 0
        tokens, segments, loss = lim.tokens, lim.segments, lim.loss
        while tokens and segments and self.waiting:
            d = self.demand[: len(self.waiting)]
            score = d @ left
            a, b, c = left + 1e-9
            score[(d[:, 0] > a) | (d[:, 1] > b) | (d[:, 2] > c)] = -1
            i = int(score.argmax())
            if score[i] < 0:
                i = int(d[:, 0].argmax())
                doc_id, start, prompt, ids, doc_tokens = self.waiting[i]
                n = self._fit(start, prompt, len(ids) // 4, tokens, loss)
                if not n:
                    break
                self._take(i)
                if 4 * n < len(ids):
                    self._wait((doc_id, start + n, prompt, ids[4 * n :], doc_tokens))
                piece = (doc_id, start, prompt, ids[: 4 * n], doc_tokens)
            else:
                piece = self._take(i)
            n, _, bears = self._demand(piece[1], piece[2], piece[3])
            self._emit(piece, bears, offset)
            tokens, segments, loss, offset = tokens - n, segments - 1, loss - bears, offset + n
            left = np.array([tokens, segments, loss]) / self.scale
        self.next_id += 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.out["doc_id"]:
            yield pa.RecordBatch.from_pydict(self.out, schema=PIECES)
            self.out = {f.name: [] for f in PIECES}


def pack_rows(rows: Iterator[pa.RecordBatch], encode: ByteBpe, limits: Limits, end_id: int, first_id: int) -> Iterator[pa.RecordBatch]:
    packer, end = Packer(limits, first_id), np.array([end_id], "<u4").tobytes()
    for batch in rows:
        for doc_id, ids, prompt in zip(batch.column("doc_id").to_pylist(), encode.many(texts(batch)), texts(batch, "prompt"), strict=True):
            packer.add(doc_id, ids + end, len(encode(prompt)) // 4 if prompt else 0)
            if len(packer.out["doc_id"]) >= 2000:
                yield from packer.flush()
    while packer.waiting:
        packer.fill()
    yield from packer.flush()


def pack_documents(docs: DataFrame, limits: Limits = Limits(), end_id: int = 1, prompt: str | Column | None = None, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents, placed in sequences within all three limits at once.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Each text is encoded, ``end_id``
    is added, and every id lands in exactly one piece. ``prompt`` names a text at the document's start
    whose ids bear no loss (null or absent: all ids do). Result: doc_id, start (ids before the piece),
    length, ids (unsigned little-endian 32-bit), doc_tokens, loss_tokens, sequence_id, offset.

    Each task packs the rows it reads, so nothing is shuffled and no task holds more than
    ``limits.window`` waiting pieces; a lost task is run again over the same rows with the same result.
    Write ``docs`` first if it comes from a shuffle without a fixed order.

    Null or empty text: one piece with ``end_id`` alone. Null doc_id: packed, and stays null. Repeated
    rows: each is packed. A text of any length is encoded whole and cut at sequences' ends; its ids are in memory at once. Empty table: no rows.
    """
    files = path or tokenizer_path("byte_bpe_50k.json"), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_rows(rows, encoder(*files), limits, end_id, TaskContext.get().partitionId() << 40)

    given = F.lit(None) if prompt is None else F.col(prompt) if isinstance(prompt, str) else prompt
    return docs.select("doc_id", "text", given.cast("string").alias("prompt")).mapInArrow(run, PIECES_DDL)
