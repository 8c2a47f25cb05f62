"""Which of a document's keys other documents hold too, without a row for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes

#: A chunk is what one task handles at once: at most so many documents, and about so many keys.
CHUNK_DOCS, CHUNK_KEYS = 1 << 16, 1 << 20
#: A key of so many documents of a chunk is heavy: it is sent once, without its documents.
HEAVY = 32
#: Class of a heavy key; of others the class is the binary logarithm of their number of documents, rounded down.
HEAVY_CLASS = 255
#: Tokens have fewer bits; above them is the number of a document's earlier keys that are cut to the same token.
NUMBER_BIT = 53

Extract = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

_RUNS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("refs", pa.binary()), ("heavy", pa.binary()), ("docs", pa.binary())])
_RUNS_DDL = "bucket long, chunk long, keys binary, refs binary, heavy binary, docs binary"
OUT_DDL = "doc_id long, text_key long, n long, h1 long, h2 long, keys binary, classes binary"


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def tokens(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys cut to their first bits: the bucket's number and 32 more."""
    return keys >> np.uint64(32 - (buckets.bit_length() - 1))


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the keys of ``docs``: a power of two that grows with the input.

    A bucket stands for the keys of 1 to 2 MB of text up to 2 TB; beyond, there are 2^20 and it grows (about 100 MB at 100 TB),
    as a chunk has about 2^20 keys and more buckets would mean a row for each of them.
    """
    return 1 << max(10, min(20, (input_bytes(docs) // (1 << 21)).bit_length()))


def _chunk(chunk: int, rows: list[tuple[int, int]], keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk: its keys by bucket, and what is known of its documents alone."""
    ref = np.repeat(np.arange(len(rows), dtype=np.uint16), counts)
    order = np.argsort(keys, kind="stable")
    keys, ref = keys[order], ref[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (ref[1:] != ref[:-1])] if len(keys) else np.zeros(0, bool)
    keys, ref = keys[fresh], ref[fresh]
    n = np.bincount(ref, minlength=len(rows))
    sums = [np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)]
    by_doc = np.argsort(ref, kind="stable")
    some = np.nonzero(n)[0]
    if len(some):
        cuts = (np.cumsum(n) - n)[some]
        for s, m in zip(sums, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), strict=True):
            s[some] = np.add.reduceat(_mixed(keys[by_doc], m), cuts)
    token = tokens(keys, buckets)  # in the keys' order; keys of one document that are cut to the same token stay apart
    starts = np.nonzero(np.r_[True, token[1:] != token[:-1]])[0] if len(token) else np.zeros(0, int)
    size = np.diff(np.r_[starts, len(token)])
    heavy = np.repeat(size >= HEAVY, size)
    docs = np.array([(i if i is not None else 0) for i, _ in rows], np.int64), np.array([k for _, k in rows], np.int64), n.astype(np.int64), *sums
    blob = b"".join(x.tobytes() for x in docs)
    # the documents of heavy keys know of them from here; the others learn it from the bucket
    yield pa.RecordBatch.from_pydict({"bucket": [-1 - chunk], "chunk": [chunk], "keys": [token[heavy].tobytes()], "refs": [ref[heavy].tobytes()], "heavy": [None], "docs": [blob]}, schema=_RUNS)
    big = token[starts[size >= HEAVY]]
    token, ref = token[~heavy], ref[~heavy]
    edges = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    a, b = np.searchsorted(token, edges), np.searchsorted(big, edges)
    out: dict[str, list] = {f.name: [] for f in _RUNS}
    for k in np.nonzero((np.diff(a) > 0) | (np.diff(b) > 0))[0].tolist():
        for name, value in zip(out, (k, chunk, token[a[k] : a[k + 1]].astype(np.uint32).tobytes(), ref[a[k] : a[k + 1]].tobytes(), big[b[k] : b[k + 1]].astype(np.uint32).tobytes(), None), strict=True):
            out[name].append(value)
    if out["bucket"]:
        yield pa.RecordBatch.from_pydict(out, schema=_RUNS)


def _bucket(rows: pa.Table) -> pa.Table:
    """For each chunk the keys that more than one document holds, with their classes."""
    if rows.column("bucket")[0].as_py() < 0:
        return rows.select(["chunk", "keys", "refs", "docs"]).append_column("classes", pa.array([b"\xff" * (len(k.as_py()) // 8) for k in rows.column("keys")], pa.binary()))
    bucket, chunks = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
    keys = [np.frombuffer(x, np.uint32) for x in rows.column("keys").to_pylist()]
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat, refs = np.concatenate(keys), np.concatenate([np.frombuffer(x, np.uint16) for x in rows.column("refs").to_pylist()])
    big = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("heavy").to_pylist()]))
    order = np.argsort(flat, kind="stable")
    flat, refs, owner = flat[order], refs[order], owner[order]
    starts = np.nonzero(np.r_[True, flat[1:] != flat[:-1]])[0] if len(flat) else np.zeros(0, int)
    size = np.diff(np.r_[starts, len(flat)])
    kind = np.log2(np.maximum(size, 1)).astype(np.uint8)
    kind[np.isin(flat[starts], big)] = HEAVY_CLASS
    shared = np.repeat((size > 1) | (kind == HEAVY_CLASS), size)
    kind = np.repeat(kind, size)[shared]
    flat, refs, owner = flat[shared].astype(np.uint64) | np.uint64(bucket << 32), refs[shared], owner[shared]
    order = np.argsort(owner, kind="stable")
    flat, refs, owner, kind = flat[order], refs[order], owner[order], kind[order]
    cut = np.searchsorted(owner, np.arange(len(chunks) + 1))
    some = [i for i in range(len(chunks)) if cut[i + 1] > cut[i]]
    piece = lambda x: [x[cut[i] : cut[i + 1]].tobytes() for i in some]
    return pa.table({"chunk": pa.array([chunks[i] for i in some], pa.int64()), "keys": pa.array(piece(flat), pa.binary()), "refs": pa.array(piece(refs), pa.binary()), "docs": pa.array([None] * len(some), pa.binary()), "classes": pa.array(piece(kind), pa.binary())})


def _assemble(rows: pa.Table, least: float) -> pa.Table:
    """A row for each document of a chunk."""
    blob = next(x for x in rows.column("docs").to_pylist() if x)
    ids, text_keys, n, h1, h2 = np.frombuffer(blob, np.int64).reshape(5, -1)
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()])
    keys, refs, classes = join("keys", np.uint64), join("refs", np.uint16), join("classes", np.uint8)
    order = np.lexsort((keys, refs))
    keys, refs, classes = keys[order], refs[order], classes[order]
    again = np.r_[False, (keys[1:] == keys[:-1]) & (refs[1:] == refs[:-1])] if len(keys) else np.zeros(0, bool)
    if again.any():  # a document's second key of a token, and so on: its number goes above the token
        at = np.arange(len(keys))
        keys = keys | (at - np.maximum.accumulate(np.where(again, 0, at))).astype(np.uint64) << np.uint64(NUMBER_BIT)
        order = np.lexsort((keys, refs))
        keys, refs, classes = keys[order], refs[order], classes[order]
    cut = np.searchsorted(refs, np.arange(len(ids) + 1))
    has = np.diff(cut) >= np.maximum(1, np.ceil(least * n - 1e-9))
    part = lambda x: pa.array([x[cut[i] : cut[i + 1]].tobytes() if has[i] else None for i in range(len(ids))], pa.binary())
    return pa.table({"doc_id": ids, "text_key": text_keys, "n": n, "h1": h1, "h2": h2, "keys": part(keys), "classes": part(classes)})


def shared_keys(docs: DataFrame, extract: Extract, least: float = 0.0, buckets: int = 0) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) with a doc_id: its distinct keys and the shared ones.

    ``extract`` gives for a list of texts their 64-bit keys, text after text, and each text's number
    of keys. Result: doc_id, text_key (hash of the text), n (distinct 64-bit keys), h1 and h2 (128 bits of the
    set of keys, alike for equal sets), keys (sorted unsigned 64-bit, each held by another row too)
    and their classes (see HEAVY_CLASS). Rows whose shared keys are fewer than ``least`` * n get null keys.

    Keys are counted whole, then cut to 32 bits and the bucket's number, at least 42 bits in all; a
    document's keys that are cut alike stay as many, told apart from bit NUMBER_BIT on. Two shuffles: keys
    with a 16-bit reference by bucket, 6 bytes each, and the shared ones back by chunk. A key that a
    third of all rows hold costs HEAVY - 1 references a chunk at most. Buckets grow with the input
    (see ``bucket_count``). A very long text is a chunk of its own, held by one task as its keys, 10 bytes each.
    """
    buckets = buckets or bucket_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple[int, int]] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids, text_keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))
            at = 0
            while at < len(ids):
                to, length = at, 0
                while to < len(ids) and length < (1 << 20):
                    length, to = length + len(texts[to]) + 1, to + 1
                k, n = extract(texts[at:to])
                keys.append(k)
                counts.append(n)
                rows += zip(ids[at:to], text_keys[at:to], strict=True)
                size, at = size + len(k), to
                if size >= CHUNK_KEYS or len(rows) > CHUNK_DOCS - 2100:
                    yield from _chunk(part << 24 | number, rows, np.concatenate(keys), np.concatenate(counts), buckets)
                    rows, keys, counts, size, number = [], [], [], 0, number + 1
        if rows:
            yield from _chunk(part << 24 | number, rows, np.concatenate(keys), np.concatenate(counts), buckets)

    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runs = given.mapInArrow(run, _RUNS_DDL)
    found = runs.groupBy("bucket").applyInArrow(_bucket, "chunk long, keys binary, refs binary, docs binary, classes binary")
    return found.groupBy("chunk").applyInArrow(lambda t: _assemble(t, least), OUT_DDL)
