"""Removing repeated byte strings by a common-prefix-aware distributed merge sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, stage_by
from .shared_keys import bucket_count, shared_keys, tokens

#: A byte that UTF-8 never has; ends the forward part of a suffix's key.
END = b"\xff"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over h[i : i + width] for each i where that fits."""
    size, out = 1, h
    while 2 * size <= width:
        out, size = pick(out[:-size], out[size:]), 2 * size
    return pick(out[: len(h) - width + 1], out[width - size : len(h) - size + 1]) if size < width else out


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and 64-bit keys of each text's anchors, text after text, and how many each text has.

    A position is an anchor if its gram's hash is the least of those in some stretch of ``length``
    bytes of the text. So every such stretch has an anchor, and equal stretches have the same ones.
    """
    gap = b"\0" * length
    buffer = gap.join(texts) + gap + b"\0" * 24
    n = len(buffer) - 24
    a, b, c = (np.ndarray((n,), "<u8", buffer, offset=o, strides=(1,)) for o in (0, 8, gram - 8))
    h = a * _M[0]
    h ^= h >> np.uint64(32)
    h += b * _M[1]
    h ^= h >> np.uint64(29)
    h += c * _M[2]
    h ^= h >> np.uint64(32)
    h *= _M[0]
    h |= np.uint64(1)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + length) - sizes - length
    width = length - gram + 1
    if n < 2 * width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    least = _sliding(h, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int8)  # where a stretch starts that ends in the same text
    some = sizes >= length
    inside[begin[some]] += 1
    inside[begin[some] + sizes[some] - length + 1] -= 1
    least[np.cumsum(inside[:-1]) == 0] = 0
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.nonzero(most[: len(h)] == h[: len(most)])[0]
    owner = np.searchsorted(begin, at, "right") - 1
    key = h[at]  # the least of many hashes, so their first bits are not even; mixed again they are
    key = (key ^ (key >> np.uint64(32))) * _M[1]
    key = (key ^ (key >> np.uint64(29))) * _M[2]
    return at - begin[owner], key ^ (key >> np.uint64(32)), np.bincount(owner, minlength=len(texts))


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, key, payload).

    Each waiting key knows the prefix that it shares with the last one taken. Of two, the one that
    shares more comes first, without a look at either; where they share alike, bytes are compared
    from there on only, and the loser remembers how far the two agreed.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.prefix, self.key, self.load = [0] * self.k, [None] * self.k, [None] * self.k
        for r in range(len(runs)):
            self._next(r)
            self.prefix[r] = 0
        self.tree = [-1] * self.k  # losers; 0 is the winner
        for r in range(self.k):
            self._play(r, True)

    def _next(self, r: int) -> None:
        self.prefix[r], self.key[r], self.load[r] = next(self.runs[r], (-1, None, None)) if r < len(self.runs) else (-1, None, None)

    def _play(self, r: int, filling: bool = False) -> None:
        prefix, key, tree = self.prefix, self.key, self.tree
        node = (r + self.k) >> 1
        while node:
            other = tree[node]
            if other < 0:
                if filling:
                    tree[node] = r
                    return
            elif key[other] is not None:
                if key[r] is None or prefix[other] > prefix[r]:
                    tree[node], r = r, other
                elif prefix[other] == prefix[r]:
                    x, y, at = key[r], key[other], prefix[r]
                    p, q = x[at:], y[at:]
                    if p == q:
                        at = len(x)
                    else:
                        m = min(len(p), len(q))
                        d = int.from_bytes(p[:m], "big") ^ int.from_bytes(q[:m], "big")
                        at += m - (d.bit_length() + 7) // 8
                    if p > q:
                        prefix[r] = at
                        tree[node], r = r, other
                    else:
                        prefix[other] = at
            node >>= 1
        tree[0] = r

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.key[w := self.tree[0]] is not None:
            yield self.prefix[w], self.key[w], self.load[w]
            self._next(w)
            self._play(w)


def front_coded(entries: dict[bytes, list]) -> dict[str, bytes]:
    """A run: keys in order, each as the prefix shared with the one before and what follows; each key's places."""
    shared, rest, last = bytearray(), [], b""
    docs, text_keys, places, counts = [], [], [], []
    for key in sorted(entries):
        m = min(len(key), len(last))
        d = int.from_bytes(key[:m], "big") ^ int.from_bytes(last[:m], "big")
        same = m - (d.bit_length() + 7) // 8
        shared.append(same)
        rest.append(key[same:])
        doc, text_key, at = entries[key]
        docs.append(doc)
        text_keys.append(text_key)
        places.extend(at)
        counts.append(len(at))
        last = key
    return {"shared": bytes(shared), "sizes": bytes(map(len, rest)), "rest": b"".join(rest), "doc": np.array(docs, np.int64).tobytes(), "text_keys": np.array(text_keys, np.int64).tobytes(), "counts": np.array(counts, np.uint32).tobytes(), "places": np.array(places, np.int64).tobytes()}


def decoded(run: dict[str, bytes]) -> Iterator[tuple[int, bytes, tuple]]:
    key, at, place = b"", 0, 0
    rest, places = run["rest"], np.frombuffer(run["places"], np.int64).tolist()
    columns = (np.frombuffer(run[c], kind).tolist() for c, kind in (("doc", np.int64), ("text_keys", np.int64), ("counts", np.uint32)))
    for same, size, doc, text_key, n in zip(run["shared"], run["sizes"], *columns, strict=True):
        key = key[:same] + rest[at : at + size]
        yield same, key, (doc, text_key, places[place : place + n])
        at, place = at + size, place + n


#: Distinct contexts of a gram up to which each pair's common stretch is measured; of more, their stretches are tabled by offset.
PAIRED = 48


def group_cuts(group: list[tuple[bytes, list[tuple]]], length: int, gram: int, paired: int = PAIRED) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(document, start, stop) of what is to go, from suffixes that share an anchor's gram.

    ``group`` has each distinct key with the (doc, text_key, places) that hold it. Bit o of a mask stands for the stretch that
    begins o bytes before the anchor.
    """
    split = [(key.partition(END)[0], key.partition(END)[2], min(d for d, _, _ in held), held) for key, held in group]
    masks = _paired_masks(split, length, gram) if len(group) <= paired else _tabled_masks(split, length, gram)
    for (doc, text_key, places), mask in masks:
        while mask:
            low = (mask & -mask).bit_length() - 1
            high = low + (~(mask >> low) & ((mask >> low) + 1)).bit_length() - 1  # bits low to high - 1 are set
            mask &= -1 << high
            for p in places:
                yield (doc, text_key), p - high + 1, p - low + length


def _paired_masks(split: list[tuple], length: int, gram: int) -> Iterator[tuple[tuple, int]]:
    """(document, text_key, places) and mask by the common prefixes of each two rows, forwards from the anchor and backwards."""
    reach, n = length - gram, len(split)
    wide, back = 8 * length, 8 * reach
    rows = [(int.from_bytes(r.ljust(length, b"\0"), "big"), len(r), int.from_bytes(b.ljust(reach, b"\0"), "big"), len(b), least) for r, b, least, _ in split]
    found: list[list[tuple[int, int]]] = [[] for _ in split]  # for each row the least document and the mask of another
    for i, (right, nr, left, nl, least) in enumerate(rows):
        if nr + nl >= length:
            found[i].append((least, (2 << nl) - (1 << max(0, length - nr))))
        for j in range(i + 1, n):
            right_, nr_, left_, nl_, least_ = rows[j]
            low = length - min(nr, nr_, (wide - (right ^ right_).bit_length()) >> 3)
            high = min(nl, nl_, (back - (left ^ left_).bit_length()) >> 3)
            if high >= low:
                mask = (2 << high) - (1 << max(0, low))
                found[i].append((least_, mask))
                found[j].append((least, mask))
    for i, near in enumerate(found):
        for one in split[i][3]:
            mask = 0
            for least, m in near:
                if least < one[0]:
                    mask |= m
            if mask:
                yield one, mask


def _tabled_masks(split: list[tuple], length: int, gram: int) -> Iterator[tuple[tuple, int]]:
    """The same by a table of the least document of each stretch, one offset after the other, so one table is held at a time."""
    masks = [[0] * len(held) for _, _, _, held in split]
    for o in range(length - gram + 1):
        least: dict[tuple, int] = {}
        fits = [i for i, (right, left, _, _) in enumerate(split) if len(left) >= o and len(right) >= length - o]
        for i in fits:
            right, left, doc, _ = split[i]
            w = left[:o], right[: length - o]
            if least.get(w, doc) >= doc:
                least[w] = doc
        for i in fits:
            right, left, _, held = split[i]
            first = least[left[:o], right[: length - o]]
            for k, one in enumerate(held):
                if first < one[0]:
                    masks[i][k] |= 1 << o
    for (_, _, _, held), found in zip(split, masks, strict=True):
        yield from ((one, m) for one, m in zip(held, found, strict=True) if m)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (rows of start, stop) in order, those that touch or overlap joined."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.r_[True, r[1:, 0] > reach[:-1]]
    return np.stack([r[new, 0], np.r_[reach[:-1][new[1:]], reach[-1]]], 1)


_RUN = ("shared", "sizes", "rest", "doc", "text_keys", "counts", "places")
_RUN_DDL = "part long, " + ", ".join(f"{c} binary" for c in _RUN)
_CUTS_DDL = "doc_id long, text_key long, cuts binary"


def _cut_table(cuts: dict[tuple[int, int], list]) -> pa.Table:
    keys = list(cuts)
    return pa.table({"doc_id": pa.array([k[0] for k in keys], pa.int64()), "text_key": pa.array([k[1] for k in keys], pa.int64()), "cuts": pa.array([merged(np.array(cuts[k], np.int64).reshape(-1, 2)).tobytes() for k in keys], pa.binary())})


def repeated_cuts(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """doc_id, text_key, cuts: byte ranges to be removed from each text, some of them, with repeats across rows.

    See ``remove_repeats``. ``docs`` has doc_id (not null), text_key and text (not null).
    """
    buckets = bucket_count(docs)
    parts = 1 << max(8, min(20, (input_bytes(docs) // (1 << 19)).bit_length()))
    found = shared_keys(docs, lambda texts: anchors([t.encode() for t in texts], length, gram)[1:], 0.0, buckets).where("keys is not null").select("doc_id", "text_key", "keys")
    reach = length - gram

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted front-coded runs by part; and, as part below 0, ranges that this task already knows."""
        task = TaskContext.get().partitionId()
        held: dict[int, dict[bytes, list]] = {}
        cuts: dict[tuple[int, int], list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [{"part": p} | front_coded(entries) for p, entries in sorted(held.items())]
            if cuts:
                t = _cut_table(cuts)
                data = t.column("cuts").to_pylist()
                rows.append({"part": -1 - task, "doc": np.array(t.column("doc_id")).tobytes(), "text_keys": np.array(t.column("text_key")).tobytes(), "counts": np.array([len(x) for x in data], np.uint32).tobytes(), "places": b"".join(data)})
            for r in rows:
                yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int64())} | {c: pa.array([r.get(c)], pa.binary()) for c in _RUN})

        for batch in batches:
            for doc, text_key, text, keys in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "keys")), strict=True):
                t = text.encode()
                at, h, _ = anchors([t], length, gram)
                cut = tokens(h, buckets)
                keys = np.frombuffer(keys, np.uint64)
                mine = np.minimum(np.searchsorted(keys, cut), len(keys) - 1)
                ok = keys[mine] == cut
                for p, part in zip(at[ok].tolist(), (h[ok] >> np.uint64(64 - (parts.bit_length() - 1))).tolist(), strict=True):
                    key = t[p : p + length] + END + t[max(0, p - reach) : p][::-1]
                    entries = held.get(part)
                    if entries is None:
                        entries = held[part] = {}
                    had = entries.get(key)
                    if had is None:
                        entries[key] = [doc, text_key, [p]]
                        size += 1
                    elif had[0] == doc:
                        had[2].append(p)
                    else:
                        # of several documents with this stretch only the first goes on; the others lose it here
                        if doc < had[0]:
                            entries[key] = [doc, text_key, [p]]
                            lost, places = (had[0], had[1]), had[2]
                        else:
                            lost, places = (doc, text_key), [p]
                        right, left = key.index(END), len(key) - key.index(END) - 1
                        if right + left >= length:
                            cuts.setdefault(lost, []).extend((x - left, x + right) for x in places)
                if size >= 1 << 20 or len(cuts) >= 1 << 16:
                    yield from flush()
                    held.clear()
                    cuts.clear()
                    size = 0
        yield from flush()

    def merge(rows: pa.Table) -> pa.Table:
        """What is to go, from the merged runs of a part."""
        cuts: dict[tuple[int, int], list] = {}
        if rows.column("part")[0].as_py() < 0:
            for r in rows.to_pylist():
                at = 0
                for doc, text_key, n in zip(np.frombuffer(r["doc"], np.int64).tolist(), np.frombuffer(r["text_keys"], np.int64).tolist(), np.frombuffer(r["counts"], np.uint32).tolist(), strict=True):
                    cuts.setdefault((doc, text_key), []).append(np.frombuffer(r["places"][at : at + n], np.int64).reshape(-1, 2))
                    at += n
            return _cut_table({k: np.concatenate(v) for k, v in cuts.items()})
        group: list[tuple[bytes, list]] = []

        def close() -> None:
            if len({d for _, held in group for d, _, _ in held}) > 1:
                for doc, start, stop in group_cuts(group, length, gram):
                    cuts.setdefault(doc, []).append((start, stop))

        for same, key, load in LoserTree([decoded(r) for r in rows.to_pylist()]):
            if same < gram:
                close()
                group.clear()
            if group and same == len(key) == len(group[-1][0]):
                group[-1][1].append(load)
            else:
                group.append((key, [load]))
        close()
        return _cut_table(cuts)

    sent = docs.select("doc_id", "text_key", "text").join(found, ["doc_id", "text_key"]).mapInArrow(runs, _RUN_DDL)
    return sent.groupBy("part").applyInArrow(merge, _CUTS_DDL)


def first_copies(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the smallest doc_id of each text, bucketed by (doc_id, text_key), and the other rows, with texts below ``length`` bytes only.

    ``docs`` has doc_id, text_key, text_key2 (together 128 bits of the text), text. Texts are shuffled once, by
    document, so a text that many documents hold is spread; the firsts are found on hashes alone.
    """
    spark, n = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("doc_id", "text_key", "text_key2", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    first = keys.groupBy("text_key", "text_key2").agg(F.min("doc_id").alias("doc_id"))
    dealt = docs.repartition(n, "doc_id", "text_key")
    held = dealt.join(first, ["doc_id", "text_key", "text_key2"], "left_semi").select("doc_id", "text_key", "text")
    small = keys.withColumn("text", F.when(F.col("n_bytes") < length, F.col("text")))
    return stage_by(held, ["doc_id", "text_key"], "texts"), small.join(first, ["doc_id", "text_key", "text_key2"], "left_anti")


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """doc_id, text (bytes left, as binary), n_bytes, n_removed, n_spans for each row of ``docs`` (doc_id, text).

    Every byte goes that is covered by a string of ``length`` bytes which
    also starts in a document with a smaller doc_id; strings are those of the input, and never cross
    documents. Null text is empty. Rows with a null doc_id keep their text and take part in nothing. Rows with
    equal ids never cut each other. Other columns are ignored. A very long text is searched in one task, which holds it, the
    hashes of its places and the suffixes at its anchors; its cuts come together in one task as byte ranges.

    Of equal texts only that of the smallest doc_id is searched; the others go whole, unless they are
    shorter than ``length``. Only suffixes that start at anchors (see ``anchors``; 2 of about ``length - gram``
    positions) are needed to find every shared string, and of these only those whose gram another row holds
    too, which a first pass finds without sending the suffixes. Each task sorts its suffixes (``length`` bytes
    on from the anchor, then ``length - gram`` backwards) and sends front-coded runs by the gram's hash; a
    string that several documents of a task hold is sent once. Loser trees merge the runs.
    """
    if not 16 <= gram < length or 2 * length - gram >= 255:
        raise ValueError("gram must be at least 16 and below length, and 2 * length - gram below 255")
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_key"), F.xxhash64(F.lit(1), whole).alias("text_key2"))
    known, copies = first_copies(rows.where("doc_id is not null"), length)
    cuts = repeated_cuts(known, length, gram).groupBy("doc_id", "text_key").agg(F.collect_list("cuts").alias("cuts"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, removed, spans, size = [], [], [], []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                t = text.encode()
                r = merged(np.frombuffer(b"".join(cut), np.int64).reshape(-1, 2)) if cut else np.zeros((0, 2), np.int64)
                at, kept = 0, []
                for a, b in r.tolist():
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                out.append(b"".join(kept))
                size.append(len(t))
                removed.append(len(t) - len(out[-1]))
                spans.append(len(r))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.binary()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())})

    joined = known.join(cuts, ["doc_id", "text_key"], "left").select("doc_id", "text", "cuts")
    joined = joined.unionByName(rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("cuts")))
    gone = F.col("n_bytes") >= length
    none = F.lit(0).cast("long")
    left = copies.select("doc_id", F.when(gone, F.lit("")).otherwise(F.col("text")).cast("binary").alias("text"), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(none).alias("n_removed"), F.when(gone, F.lit(1).cast("long")).otherwise(none).alias("n_spans"))
    return joined.mapInArrow(apply, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long").unionByName(left)


def brute_force(rows: list[tuple[int, str]], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """The same for a small fixture, string by string: doc_id to n_bytes, n_removed, n_spans, sha256."""
    first: dict[bytes, int] = {}
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in texts:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        left = bytes(b for b, g in zip(t, gone.tolist(), strict=False) if not g)
        out[i] = len(t), len(t) - len(left), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(left).hexdigest()
    return out
