"""Finding benchmark passages, also slightly changed ones, by q-gram lemma filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes are compared with A-Z in lower case and white space as a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\v\f\r" else b for b in range(256))
#: Stands between texts; a q-gram that holds it is never looked up.
GAP = b"\0" * 16
_BIG = 1 << 24
#: Bytes of text that are searched at once, and meetings of a text's and the items' grams that are looked at at once.
WINDOW, EXPAND = 1 << 18, 1 << 22
#: A gram that an item holds at more places has no postings there.
SELF = 8


def grams(buffer: bytes, q: int) -> np.ndarray:
    """A 64-bit key of each q bytes (1 to 15) of ``buffer``; keys past its last q-gram are meaningless."""
    raw = buffer + GAP
    a = np.ndarray((len(buffer),), "<u8", raw, strides=(1,))
    if q < 8:
        b = a & np.uint64((1 << 8 * q) - 1)
    else:
        b = np.ndarray((len(buffer),), "<u8", raw, offset=q - 8, strides=(1,))
        b = b * np.uint64(0xC2B2AE3D27D4EB4F)
        b ^= b >> np.uint64(29)
        b += a * np.uint64(0x9E3779B97F4A7C15)
        return b
    b *= np.uint64(0x9E3779B97F4A7C15)
    return b ^ (b >> np.uint64(32))


def alignment(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """Edits, start and stop of the stretch of ``text`` nearest to ``item``, if it takes at most ``most`` edits.

    ``text`` may begin and end anywhere around the stretch. The band is as wide as the text is longer
    than the item, and ``most`` more on each side.
    """
    m, n = len(item), len(text)
    low, high = -most, max(0, n - m) + most
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    padded = np.full(m + high - low + 1, 256, np.int64)
    width = high - low + 1
    usable = min(n, m + high)
    padded[-low : -low + usable] = b[:usable]
    k = np.arange(width)
    start = k + low  # the text's bytes before the diagonal
    d = np.where((start >= 0) & (start <= n), start, most + m + n + 2) + np.where((start >= 0) & (start <= n), 0, m + 1) * _BIG
    step = k * _BIG
    for i in range(m):
        # cell k of row i+1 stands for text position i + 1 + start[k]
        same = d + np.where(padded[i : i + width] == a[i], 0, _BIG)
        drop = np.append(d[1:], (m + 1) * _BIG * 2) + _BIG
        d = np.minimum.accumulate(np.minimum(same, drop) - step) + step
        pos = i + 1 + start
        d[(pos < 0) | (pos > n)] = 2 * (m + 1) * _BIG
        if d.min() >= (most + 1) * _BIG:
            return None
    best = int(d.argmin())
    edits, begin = divmod(int(d[best]), _BIG)
    return (edits, begin, m + low + best) if edits <= most else None


def gram_size(length: int, edits: int, most: int) -> int:
    """The longest q up to ``most`` for which the lemma still asks for 4 shared q-grams, or for 1 where none does."""
    fits = [[q for q in range(1, most + 1) if length + 1 - q - q * edits >= least] for least in (4, 1)]
    return max(fits[0] or fits[1])


@dataclass
class Index:
    """Postings of the q-grams of some items, which all have one q.

    A gram that stands at more than SELF places of an item (a run of dashes, say) has no postings
    there: of these grams only an upper bound is counted, the text's places in a band's reach that hold one.
    """

    items: list[bytes]
    edits: np.ndarray
    q: int

    def __post_init__(self) -> None:
        q, sizes = self.q, np.array([len(t) for t in self.items], np.int64)
        self.need = sizes + 1 - q - q * self.edits
        self.longest = int(sizes.max())
        self.reach = int((sizes + 6 * self.edits).max()) + 8
        flat = np.concatenate([grams(t, q)[: len(t) - q + 1] for t in self.items])
        n = sizes - q + 1
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        self.keys, slot = np.unique(flat, return_inverse=True)
        rank = slot * len(n) + owner
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        start = np.nonzero(np.r_[True, rank[1:] != rank[:-1]])[0]
        times = np.diff(np.r_[start, len(rank)])
        often = np.repeat(times > SELF, times)
        self.rank, self.place = rank[~often], place[~often]
        many = rank[start[times > SELF]]
        self.often_item, self.often_slot = many % len(n), many // len(n)
        self.often = np.bincount(self.often_item, times[times > SELF], len(n)).astype(np.int64)
        self.is_often = np.zeros(len(self.keys), bool)
        self.is_often[self.often_slot] = True
        self.first = np.searchsorted(self.rank, np.arange(len(self.keys) + 1) * len(n))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def regions(self, buffer: bytes, base: int) -> Iterator[tuple[int, int, int]]:
        """(item, start, stop) of stretches of the whole text that may hold an item, from its part ``buffer`` that begins at ``base``."""
        keys = grams(buffer, self.q)
        at = np.nonzero(self.bits[keys >> np.uint64(42)])[0]
        slot = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[slot] == keys[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return
        item, band = (np.concatenate(x) for x in zip(*self._bands(at, slot), strict=True))
        if not len(item):
            return
        order = np.lexsort((band, item))
        item, band = item[order], band[order]
        width = self.edits[item] + 1
        run = np.maximum(1, (1 << 16) // width)  # neighbouring bands are aligned together, up to 64 KB of text
        cut = np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1] + 1) | (band[1:] % run[1:] == 0)]
        first = np.nonzero(cut)[0]
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(item)], strict=True):
            i, e = int(item[a]), int(self.edits[item[a]])
            yield i, base + int(band[a]) * (e + 1) - self.longest - e, base + (int(band[b - 1]) + 2) * (e + 1) - self.longest + len(self.items[i]) + e

    def _bands(self, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items and their bands of 2 (e + 1) diagonals with enough shared q-grams; bands overlap by half, so any e + 1 neighbours lie in one."""
        n = len(self.items)
        limits = [(0, n)]
        if (self.first[slot + 1] - self.first[slot]).sum() > EXPAND:  # items in groups, each with a bounded number of meetings
            load = np.bincount(self.rank % n, np.bincount(slot, minlength=len(self.keys))[self.rank // n], n)
            group = np.floor(np.cumsum(load) / EXPAND)
            edges = np.r_[0, np.nonzero(np.diff(group))[0] + 1, n]
            limits = [(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        met = np.unique(self.often_item[np.isin(self.often_slot, np.unique(slot[self.is_often[slot]]))])
        for low, high in limits:
            f, m = np.searchsorted(self.rank, slot * n + low), 0
            m = np.searchsorted(self.rank, slot * n + high) - f
            which = np.repeat(f, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item, place = self.rank[which] % n, self.place[which]
            bands_of, places_of = int(at[-1]) + 2 * self.longest + 2, self.longest + 1
            band = (np.repeat(at, m) - place + self.longest) // (self.edits[item] + 1)
            key = (item * bands_of + band) * places_of + place
            pairs = np.unique(np.concatenate([key, key[band > 0] - places_of]))
            bands, count = np.unique(pairs // places_of, return_counts=True)
            item, band = bands // bands_of, bands % bands_of
            kept = count >= self.need[item]
            yield item[kept], band[kept]
            for i in met[(met >= low) & (met < high)].tolist():
                # of the grams that this item repeats, no more are shared than the text has in the band's reach
                own, e = item == i, int(self.edits[i])
                here = at[np.isin(slot, self.often_slot[self.often_item == i])]
                b = np.arange((int(here[0]) + self.longest - len(self.items[i])) // (e + 1) - 2, (int(here[-1]) + self.longest) // (e + 1) + 1).clip(0)
                b = np.unique(np.concatenate([b, band[own]]))
                start = b * (e + 1) - self.longest
                stop = start + 2 * (e + 1) + len(self.items[i]) - self.q
                shared = np.minimum(np.searchsorted(here, stop) - np.searchsorted(here, start), self.often[i])
                shared[np.searchsorted(b, band[own])] += count[own]
                b = b[shared >= self.need[i]]
                yield np.full(len(b), i), b


class Items:
    """The benchmark's items by the q that their lengths allow; equal ones are looked for once."""

    def __init__(self, ids: list, texts: list[bytes], q: int, rate: float) -> None:
        self.ids: dict[bytes, list] = {}
        for i, t in zip(ids, texts, strict=True):
            self.ids.setdefault(t, []).append(i)
        by_q: dict[int, list[tuple[bytes, int]]] = {}
        for t in self.ids:
            e = int(rate * len(t))
            by_q.setdefault(gram_size(len(t), e, q), []).append((t, e))
        self.indexes = [Index([t for t, _ in some], np.array([e for _, e in some], np.int64), size) for size, some in sorted(by_q.items())]

    def find(self, texts: list[bytes]) -> list[tuple[int, object, int, int, int]]:
        """(text, item's id, start, stop, edits): the nearest place of each item in each text that holds it, of equally near ones the first."""
        folded = [t.translate(FOLD) for t in texts]
        buffer = GAP + GAP.join(folded) + GAP
        begin = np.cumsum([len(GAP), *(len(t) + len(GAP) for t in folded)])[:-1]
        found: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for index in self.indexes:
            step = max(WINDOW, 4 * index.reach)
            for base in range(0, len(buffer), step):
                for i, low, high in index.regions(buffer[base : base + step + index.reach], base):
                    item, e = index.items[i], int(index.edits[i])
                    for doc in range(max(0, int(np.searchsorted(begin, low, "right")) - 1), int(np.searchsorted(begin, high))):
                        frm, to = max(0, low - int(begin[doc])), min(len(folded[doc]), high - int(begin[doc]))
                        had = found.get((doc, item))
                        if to - frm < len(item) - e or had and not had[0] and had[1] <= frm:
                            continue
                        part = folded[doc][frm:to]
                        where = part.find(item)
                        got = (0, where, where + len(item)) if where >= 0 else alignment(item, part, min(e, had[0]) if had else e) if e else None
                        if got and (not had or (got[0], frm + got[1]) < had[:2]):
                            found[doc, item] = got[0], frm + got[1], frm + got[2]
        return sorted(((d, i, a, b, e) for (d, item), (e, a, b) in found.items() for i in self.ids[item]), key=lambda x: (x[0], str(x[1])))


def _blocks(texts: list[bytes], block: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``block`` bytes each; a longer text is one of its own."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= block):
            size, to = size + len(texts[to]) + 1, to + 1
        yield at, to
        at = to


def _groups(benchmark: DataFrame, item_bytes: int) -> Iterator:
    """The items as broadcasts of about ``item_bytes`` each; there is always one."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("text <> ''")
    groups = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    for g in range(groups):
        rows = sorted((r for r in items.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).toLocalIterator()), key=str)
        yield spark.sparkContext.broadcast(([r[0] for r in rows], [r[1].encode().translate(FOLD) for r in rows]))


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, item_bytes: int = 4 << 20, block: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, start, stop, edits: the nearest place of each benchmark item in each document that holds it.

    An item is held where a stretch of the text (bytes start to stop of its UTF-8) takes at most
    e = rate * length edits, rounded down (bytes, A-Z and white space folded), to become the item; of equally near
    stretches the first one counts. Such a stretch shares at least length + 1 - q - q e of the item's q-grams within e + 1
    neighbouring diagonals; bands with fewer are left out, the others are aligned. Short items get a smaller
    q (see ``gram_size``), so the bound always asks for something and items of every length are found, down to
    one byte. Null and empty items and null texts are never found.

    ``docs`` (doc_id, text) is read once for each ``item_bytes`` of items, which are broadcast. No
    rows are shuffled. Rows with equal or null ids are found separately; other columns are ignored. Texts are searched
    in windows, so what a task holds beside a text does not grow with the text or with how often grams repeat.
    """
    out = None
    for told in _groups(benchmark, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            items = Items(*told.value, q, rate)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), [(t or "").encode() for t in batch.column("text").to_pylist()]
                for at, to in _blocks(texts, block):
                    if hits := items.find(texts[at:to]):
                        d, i, a, b, e = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[at + x] for x in d], pa.int64()), "item_id": pa.array(i, pa.int64()), "start": pa.array(a, pa.int64()), "stop": pa.array(b, pa.int64()), "edits": pa.array(e, pa.int32())})

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, start long, stop long, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, item_bytes: int = 4 << 20, block: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` whose ``text`` holds no benchmark item (see ``find_passages``), with all their columns.

    Every row is judged by its own text, so null and repeated ids do no harm, and nothing is shuffled.
    Rows with a null or empty text stay.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    for told in _groups(benchmark, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            items = Items(*told.value, q, rate)
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                clean = np.ones(len(texts), bool)
                for at, to in _blocks(texts, block):
                    clean[[at + d for d, *_ in items.find(texts[at:to])]] = False
                yield batch.filter(pa.array(clean))

        held = held.mapInArrow(run, held.schema)
    return held.select("row.*")
