"""Language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes are compared with A-Z in lower case.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Every text is read as if these bytes came before it.
_START = b"\n\n\n"


class Ppm:
    """Code lengths in bits of each byte after up to three bytes, for each language.

    Every language has a tree of byte contexts of length 0 to 3 with the counts of what followed. In
    a context seen n times with d different bytes after it, a byte that followed c times has the
    probability c / (n + d) and the escape to the next shorter context d / (n + d); a context never
    seen costs nothing; after the empty context all 256 bytes are alike. The statistics are frozen,
    so a byte's code length is a function of four bytes. It is laid out as a table over pairs of
    adjacent bytes, which gives the same figure as walking the tree. The table has the
    ``max_pairs`` most frequent pairs; what follows contexts of length 3 with a rarer pair is looked up in
    sorted arrays, so every context counts.
    """

    def __init__(self, samples: dict[str, list[bytes]], max_pairs: int = 2000) -> None:
        self.languages = sorted(samples)
        folded = {lang: _FOLD[np.frombuffer(b"".join(_START + t for t in samples[lang]), np.uint8)] for lang in self.languages}
        if not folded:
            return
        seen = np.unique(np.concatenate(list(folded.values())))
        self.size = a = len(seen) + 1  # the last symbol stands for bytes that were never seen
        self.symbol = np.full(256, a - 1, np.uint16)
        self.symbol[seen] = np.arange(len(seen))
        self.symbol = self.symbol[_FOLD]
        text = {lang: self.symbol[f].astype(np.int64) for lang, f in folded.items()}
        pairs, times = np.unique(np.concatenate([s[:-1] * a + s[1:] for s in text.values()]), return_counts=True)
        pairs = np.sort(pairs[np.argsort(-times, kind="stable")[:max_pairs]])
        self.pairs = p = len(pairs) + 1
        self.pair = np.full(a * a, p - 1, np.uint16 if p < 65536 else np.uint32)
        self.pair[pairs] = np.arange(p - 1)
        first = np.r_[pairs // a, a - 1]
        second = np.r_[pairs % a, a - 1]
        short, long, escape = [], [], []
        self.rare: list[tuple[np.ndarray, ...]] = []  # for each language: grams of four with a rarer pair and their bits, contexts of a rarer pair and their escapes
        for lang in self.languages:
            s = text[lang]
            bits = np.full(a, 8.0)
            counts = np.bincount(s, minlength=a).astype(float)
            bits = self._step(counts[None, :], bits[None, :])[0][0]
            tables = [bits]
            for k in (1, 2):
                key = sum(s[j : len(s) - k + j] * a ** (k - j) for j in range(k + 1))
                counts = np.bincount(key, minlength=a ** (k + 1)).reshape(a**k, a).astype(float)
                below = np.broadcast_to(tables[-1].reshape(-1, a), (a ** (k - 1), a))
                tables.append(self._step(counts, np.tile(below, (a, 1)))[0])
            order2 = tables[2].reshape(a, a, a)
            short.append(order2.reshape(-1).astype(np.float32))
            grams, n = np.unique(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:], return_counts=True)
            after, start, kind = np.unique(grams // a, return_index=True, return_counts=True)
            times = np.add.reduceat(n, start) if len(n) else n
            one, two = self.pair[grams // (a * a)].astype(np.int64), self.pair[grams % (a * a)].astype(np.int64)
            c = np.zeros((p, p))
            c[one, two] = n
            c[-1], c[:, -1] = 0, 0
            # a context of three is a pair and the first byte of the next pair
            total, kinds = np.zeros((p, a)), np.zeros((p, a))
            at = self.pair[after // a].astype(np.int64)
            total[at, after % a], kinds[at, after % a] = times, kind
            total[-1], kinds[-1] = 0, 0
            rare, odd = (one == p - 1) | (two == p - 1), at == p - 1
            cost4 = np.log2(np.repeat(times + kind, kind) / n)
            self.rare.append((grams[rare], cost4[rare].astype(np.float32), after[odd], np.log2((times + kind) / kind)[odd].astype(np.float32)))
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                esc[-1] = 0
                fall = esc[:, first] + order2[second[:, None], first[None, :], second[None, :]]
                cost = np.where(c > 0, np.log2((total + kinds)[:, first] / c), fall)
            long.append(cost.reshape(-1).astype(np.float32))
            escape.append(esc.reshape(-1).astype(np.float32))
        self.short, self.long, self.escape = (np.ascontiguousarray(np.stack(x, 1)) for x in (short, long, escape))

    @staticmethod
    def _step(counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            esc = np.where(n > 0, np.log2((n + d) / d), 0.0)
            return np.where(counts > 0, np.log2((n + d) / counts), esc + below), esc

    def bits(self, texts: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """Code length of each text under each language, over its whole length."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), block):
                held.append((i, (t[at - 3 : at] if at else _START) + t[at : at + block]))
                size += len(held[-1][1])
                if size >= block:
                    self._add(held, out)
                    held, size = [], 0
        if held:
            self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes]], out: np.ndarray) -> None:
        a, p = self.size, self.pairs
        s = self.symbol[np.frombuffer(b"".join(t for _, t in held), np.uint8)].astype(np.int32)
        two = s[:-1] * a + s[1:]
        pair = self.pair[two].astype(np.int32)
        cost = self.long[pair[:-2] * p + pair[2:]]
        if len(odd := np.nonzero(pair[2:] == p - 1)[0]):
            cost[odd] = self.escape[pair[odd] * a + s[odd + 2]] + self.short[(two[odd + 1] * a) + s[odd + 3]]
        if len(odd := np.nonzero((pair[:-2] == p - 1))[0]):
            cost[odd] = self.short[two[odd + 1] * a + s[odd + 3]]
        if any(len(x[0]) for x in self.rare) and len(odd := np.nonzero((pair[:-2] == p - 1) | (pair[2:] == p - 1))[0]):
            three = two[odd].astype(np.int64) * a + s[odd + 2]
            for k, (grams, bits, after, escapes) in enumerate(self.rare):
                for keys, asked, known, over in ((after, three, escapes, False), (grams, three * a + s[odd + 3], bits, True)):
                    if len(keys):
                        found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                        hit = keys[found] == asked
                        cost[odd[hit], k] = known[found[hit]] + (0 if over else cost[odd[hit], k])
        ends = np.cumsum([len(t) for _, t in held])
        starts = np.r_[0, ends[:-1]]
        total = np.concatenate([cost, np.zeros((3, cost.shape[1]), np.float32)])
        cuts = np.stack([starts, ends - 3], 1).reshape(-1)  # the last three of each text reach into the next
        sums = np.add.reduceat(total, cuts, axis=0, dtype=np.float64)[::2]
        np.add.at(out, [i for i, _ in held], sums)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability, all languages alike beforehand; ``und`` and 0 without a letter."""
        has = [bool(t) and bool(_LETTER.search(t)) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = self.bits([t.encode() if h else b"" for t, h in zip(texts, has, strict=True)])
        best = bits.argmin(1)
        share = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], [float(x) if h else 0.0 for x, h in zip(share, has, strict=True)]


#: A longer text is learned from so many stretches spread evenly over it.
STRETCHES = 16


def stretches(text: Column, max_bytes: int) -> Column:
    """The text, or where it has more than ``max_bytes`` bytes STRETCHES stretches of it from its start to its end, a line each, that keep to them."""
    size = max(1, max_bytes // (4 * STRETCHES))
    step = (F.length(text) - size) / (STRETCHES - 1)
    some = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: text.substr((i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.array_join(some, "\n"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int, max_bytes: int) -> list:
    """At most ``per_label`` rows (doc_id, label, text) of each label among those with ``learn``, long texts by their ``stretches``.

    ``docs`` has doc_id and text, ``labels`` doc_id and ``label``; it may be ``docs`` itself, where label and text belong
    together. Documents are chosen by a hash of doc_id, so the same ones however the tables are laid out. An id with
    several labels counts for each; of several texts of an id (and label) the one with the least hash is read.
    Null ids and labels and empty texts are left out.

    Labels are counted, then ids whose hash is low enough for half as many again as asked are taken, and only
    where too few of these have a text is that share raised. So nothing is ranked or sorted by label, at most about 1.5 *
    ``per_label`` ids a label are broadcast, and as many cut texts reach the driver.
    """
    spark, same = docs.sparkSession, labels is docs
    told = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("__label"))
    read = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(label).cast("string").alias("__label")] if same else []))
    turn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    known = {r[0]: r[1] for r in told.groupBy("__label").agg(F.approx_count_distinct("doc_id")).collect()}
    share, got = {x: min(1.0, 1.5 * per_label / max(n, 1)) for x, n in known.items()}, []
    while share:
        limits = spark.createDataFrame(sorted(share.items()), "__label string, __share double")
        ids = told.join(F.broadcast(limits), "__label").where(turn < F.col("__share")).select("doc_id", "__label").distinct().collect()
        chosen = spark.createDataFrame(ids, "doc_id long, __label string")
        texts = read.join(F.broadcast(chosen), ["doc_id", "__label"] if same else ["doc_id"]).groupBy("doc_id", "__label")
        rows = texts.agg(F.min(F.struct(F.xxhash64("text"), stretches(F.col("text"), max_bytes).alias("text"))).alias("t")).select("doc_id", "__label", turn, "t.text").collect()
        again = {}
        for x in share:
            mine = sorted((r for r in rows if r[1] == x), key=lambda r: (r[2], r[0]))[:per_label]
            if len(mine) < per_label and share[x] < 1:
                again[x] = min(1.0, 4 * share[x])
            else:
                got += [(r[0], r[1], r[3]) for r in mine]
        share = again
    return sorted(got)


def train(docs: DataFrame, learn: Column, per_language: int = 300, max_bytes: int = 1 << 15) -> Ppm:
    """A model of every non-null ``lang`` of the rows with ``learn``, from at most ``per_language`` rows each (see ``training_rows``)."""
    samples: dict[str, list[bytes]] = {}
    for _, lang, text in training_rows(docs, docs, "lang", learn, per_language, max_bytes):
        samples.setdefault(lang, []).append(text.encode())
    return Ppm(samples)


def identify(docs: DataFrame, model: Ppm) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) from the whole ``text`` of each row, besides doc_id and ``held_out``.

    Null text or none with a letter: ``und``, 0. Of languages with equal code lengths the first by name wins. Only the text is read for a prediction. Rows map one
    to one, repeated ones too; other columns of ``docs`` are ignored. The model (about 40 MB for 1,500 byte pairs and four languages) is broadcast; its size
    depends on the training bound, not on the corpus.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lang, score = told.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
