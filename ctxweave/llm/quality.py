"""A byte-level convolutional network in numpy that scores documents for quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language_id import training_rows

#: Bytes that a filter sees, and from one to the next; windows of half a chunk.
WIDTH, STRIDE, HALF = 8, 4, 64
EMBED, FILTERS = 4, 16


@dataclass
class ByteCnn:
    """Filters over embedded bytes, the maximum of each over a chunk, and their mean and maximum over the chunks.

    A text is cut into overlapping chunks of 2 * HALF windows, each starting in the middle of the one
    before, which together cover all of it. What a text's chunks show goes through one logistic unit.
    """

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> ByteCnn:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(r.normal(0, 0.5, (256, EMBED)).astype(f), r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f), r.normal(0, 0.1, 2 * FILTERS).astype(f), np.zeros(1, f))

    def halves(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each half chunk the maximum of each filter; the number of half chunks of each text; the bytes and the first window of each half.

        Each text is filled up with zero bytes to whole windows, an empty one to a single window.
        """
        sizes = np.array([max(1, -(-max(0, len(t) - WIDTH) // STRIDE) + 1) for t in texts])
        parts = [t.ljust((n - 1) * STRIDE + WIDTH, b"\0") for t, n in zip(texts, sizes, strict=True)]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        # a text's bytes are a whole number of strides, so its windows start at multiples of STRIDE
        starts = np.cumsum([0, *(len(p) for p in parts)])[:-1] // STRIDE
        v = self.embed[raw].reshape(-1, STRIDE * EMBED)
        out = v[:-1] @ self.filters[: STRIDE * EMBED] + v[1:] @ self.filters[STRIDE * EMBED :] + self.bias
        n_half = -(-sizes // HALF)
        first = np.repeat(starts, n_half) + HALF * (np.arange(n_half.sum()) - np.repeat(np.cumsum(n_half) - n_half, n_half))
        last = np.minimum(first + HALF, np.repeat(starts + sizes, n_half))
        cuts = np.stack([first, last], 1).reshape(-1)
        out = np.concatenate([out, np.full((1, FILTERS), -np.inf, np.float32)])
        return np.maximum.reduceat(out, cuts, axis=0)[::2], n_half, raw, np.stack([first, last], 1)

    def features(self, halves: np.ndarray, n_half: np.ndarray) -> np.ndarray:
        """Mean and maximum over a text's chunks; a chunk is a half with the next one of the same text."""
        ends = np.cumsum(n_half)
        chunk = halves.copy()
        inner = np.ones(len(halves), bool)
        inner[ends - 1] = False
        at = np.nonzero(inner)[0]
        chunk[at] = np.maximum(halves[at], halves[at + 1])
        keep = inner | np.repeat(n_half == 1, n_half)
        n = np.maximum(n_half - 1, 1)
        cuts = np.cumsum(n) - n
        chunk = np.maximum(chunk[keep], 0)
        return np.concatenate([np.add.reduceat(chunk, cuts, axis=0) / n[:, None], np.maximum.reduceat(chunk, cuts, axis=0)], 1)

    def score(self, texts: list[str], block: int = 1 << 19) -> np.ndarray:
        """Probability of label 1 for each text, over its whole length; memory is bounded by ``block`` and the longest text's chunks."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t.encode())
            size += len(held[-1])
            if size >= block:
                out.append(self._score(held, block))
                held, size = [], 0
        if held:
            out.append(self._score(held, block))
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, texts: list[bytes], block: int) -> np.ndarray:
        step = HALF * STRIDE * max(1, block // (HALF * STRIDE))
        pieces, owner = [], []
        for i, t in enumerate(texts):  # a long text goes in stretches that start where a half chunk starts
            last = max(1, -(-max(0, len(t) - WIDTH) // STRIDE) + 1) * STRIDE
            for at in range(0, last, step):
                pieces.append(t[at : at + step + WIDTH - STRIDE])
                owner.append(i)
        halves, counts = [], np.zeros(len(texts), int)
        at, size = 0, 0
        for k, p in enumerate(pieces):
            size += len(p)
            if size >= block or k == len(pieces) - 1:
                h, n, _, _ = self.halves(pieces[at : k + 1])
                halves.append(h)
                np.add.at(counts, owner[at : k + 1], n)
                at, size = k + 1, 0
        x = self.features(np.concatenate(halves), counts)
        return 1 / (1 + np.exp(-(x @ self.weight + self.offset[0]).astype(np.float64)))

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 600, size: int = 32, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        """So many steps of Adam over the cross-entropy; through a maximum only the window that has it learns."""
        r = np.random.default_rng(seed)
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in vars(self).items()}
        order = np.zeros(0, int)
        for step in range(1, steps + 1):
            if len(order) < size:
                order = np.concatenate([order, r.permutation(len(texts))])
            rows, order = order[:size], order[size:]
            grads = self._gradients([texts[i] for i in rows], labels[rows])
            lr = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(self, k)[...] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        halves, n_half, raw, spans = self.halves(texts)
        ends = np.cumsum(n_half)
        inner = np.ones(len(halves), bool)
        inner[ends - 1] = False
        nxt = np.where(inner, np.minimum(np.arange(len(halves)) + 1, len(halves) - 1), np.arange(len(halves)))
        source = np.where(halves[nxt] > halves, nxt[:, None], np.arange(len(halves))[:, None])  # half that has a chunk's maximum
        keep = np.nonzero(inner | np.repeat(n_half == 1, n_half))[0]
        source = source[keep]
        cols = np.arange(FILTERS)
        chunk = np.maximum(halves[source, cols], 0)
        n = np.maximum(n_half - 1, 1)
        cuts = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(texts)), n)
        mean, top = np.add.reduceat(chunk, cuts, axis=0) / n[:, None], np.maximum.reduceat(chunk, cuts, axis=0)
        x = np.concatenate([mean, top], 1)
        p = 1 / (1 + np.exp(-(x @ self.weight + self.offset[0])))
        d = ((p - labels) / len(texts)).astype(np.float32)
        dx = d[:, None] * self.weight[None, :]
        dchunk = dx[doc, :FILTERS] / n[doc][:, None]
        is_top = chunk == top[doc]
        dchunk = (dchunk + is_top / np.maximum(np.add.reduceat(is_top.astype(np.float32), cuts, axis=0), 1)[doc] * dx[doc, FILTERS:]) * (chunk > 0)
        # the window of each half that has a filter's maximum
        k, f = np.nonzero(dchunk)
        g = dchunk[k, f]
        half = source[k, f]
        v = self.embed[raw].reshape(-1, STRIDE * EMBED)
        out = v[:-1] @ self.filters[: STRIDE * EMBED] + v[1:] @ self.filters[STRIDE * EMBED :] + self.bias
        window = np.empty(len(k), int)
        width = np.arange(HALF)
        for a in range(0, len(k), 1 << 15):
            lo, hi = spans[half[a : a + (1 << 15)], 0], spans[half[a : a + (1 << 15)], 1]
            at = np.minimum(lo[:, None] + width, hi[:, None] - 1)
            window[a : a + (1 << 15)] = lo + out[at, f[a : a + (1 << 15), None]].argmax(1)
        bytes_ = raw[(window * STRIDE)[:, None] + np.arange(WIDTH)]
        seen = self.embed[bytes_].reshape(len(k), -1)
        dfilters = np.zeros_like(self.filters)
        for j in range(FILTERS):
            m = f == j
            dfilters[:, j] = g[m] @ seen[m]
        dseen = (g[:, None] * self.filters.T[f]).reshape(len(k), WIDTH, EMBED)
        dembed = np.stack([np.bincount(bytes_.reshape(-1), dseen[:, :, e].reshape(-1), 256) for e in range(EMBED)], 1)
        return {"embed": dembed.astype(np.float32), "filters": dfilters, "bias": np.bincount(f, g, FILTERS).astype(np.float32), "weight": (d @ x).astype(np.float32), "offset": d.sum(keepdims=True)}


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = 1000, max_bytes: int = 1 << 14, steps: int = 600) -> ByteCnn:
    """A model from at most ``per_label`` rows of each ``quality`` (0 or 1) in ``labels`` among those with ``learn``, long texts by stretches (see ``training_rows``, also for repeated ids and contradicting labels).

    Without rows of both labels the untrained weights' unit is set to the share of label 1.
    """
    rows = training_rows(docs, labels, "quality", learn & F.col("quality").isin(0, 1), per_label, max_bytes)
    y = np.array([int(r[1]) for r in rows], np.float32)
    model = ByteCnn.new()
    if len(set(y.tolist())) < 2:
        model.weight[...] = 0
        model.offset[...] = 0 if not len(y) else 4 if y[0] else -4
        return model
    model.fit([r[2].encode() for r in rows], y, steps)
    # scores are probabilities among all labelled rows, not among the sample, which has as many rows of either label
    all_of = {int(r[0]): r[1] for r in labels.where(learn & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    model.offset += np.float32(np.log(all_of[1] / all_of[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_quality(docs: DataFrame, model: ByteCnn, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only the whole ``text`` is read for a score. Null text counts as empty, which has a score too.
    Rows map one to one. The broadcast model has about 2,000 numbers. Columns of ``keep`` called like
    the new ones are replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("score", "predicted")]
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = told.value.score([t or "" for t in batch.column("__text").to_pylist()])
            columns = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())})

    schema = docs.select(*keep).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return rows.mapInArrow(run, schema)
