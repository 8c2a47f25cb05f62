"""Near-duplicate documents by an exact Jaccard join of word shingles in prefix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .shared_keys import shared_keys

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15


def _powers(n: int, r: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), r, np.uint64)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles, text after text, and how many each text has.

    Words are runs of bytes other than [\\x20\\x09-\\x0D], A-Z in lower case. A text with fewer words
    than a shingle has one for its whole sequence, a text without words none.
    """
    folded = [t.encode().translate(_FOLD) for t in texts]
    buffer = b"\n" + b"\n".join(folded) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    space = _SPACE[raw]
    starts = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    ends = np.nonzero(~space[:-1] & space[1:])[0] + 1
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * _powers(len(raw), _R))]
    word = _mix((sums[ends] - sums[starts]) * _powers(len(raw) + 1, pow(_R, -1, 1 << 64))[starts] + (ends - starts).astype(np.uint64))
    offset = np.cumsum([1, *(len(t) + 1 for t in folded)])
    first = np.searchsorted(starts, offset)
    n_words = np.diff(first)
    if len(word) >= words:
        h = np.zeros(len(word) - words + 1, np.uint64)
        for j in range(words):
            h = _mix(h * np.uint64(31) + word[j : len(word) - words + 1 + j])
    else:
        h = np.zeros(0, np.uint64)
    n = np.maximum(n_words - words + 1, 0)
    at = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = h[at]
    short = np.nonzero((n_words > 0) & (n_words < words))[0]
    if len(short):
        whole = [int.from_bytes(hashlib.blake2b(b"\0".join(folded[i].translate(None, b"").split()), digest_size=8, person=b"short").digest(), "little") for i in short]
        out = np.insert(out, (np.cumsum(n) - n)[short], np.array(whole, np.uint64))
        n[short] = 1
    return out, n


def need(n: int, percent: int) -> int:
    """Shared elements without which no partner reaches ``percent`` for a set of ``n``."""
    return -(-percent * n // 100)


class Groups:
    """Union-find over small numbers; a group's root is its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


class _Node:
    """An edge's tokens, what is below, and the sizes and members found there."""

    __slots__ = ("tokens", "below", "ends", "low", "high", "longest")

    def __init__(self, tokens: tuple) -> None:
        self.tokens, self.below, self.ends = tokens, {}, []
        self.low, self.high, self.longest = 1 << 62, 0, 0


class PrefixTree:
    """Sets in one global order of tokens; sets that begin alike share nodes."""

    def __init__(self, percent: int) -> None:
        self.root, self.percent = _Node(()), percent

    def add(self, member: int, size: int, tokens: tuple) -> None:
        node, at = self.root, 0
        while True:
            rest = len(tokens) - at
            node.low, node.high, node.longest = min(node.low, size), max(node.high, size), max(node.longest, rest)
            if not rest:
                node.ends.append((member, size))
                return
            child = node.below.get(tokens[at])
            if child is None:
                child = node.below[tokens[at]] = _Node(tokens[at:])
                child.low = child.high = size
                child.ends.append((member, size))
                return
            same = 0
            for a, b in zip(child.tokens, tokens[at:], strict=False):
                if a != b:
                    break
                same += 1
            if same < len(child.tokens):
                upper = _Node(child.tokens[:same])
                upper.low, upper.high, upper.longest = child.low, child.high, child.longest + len(child.tokens) - same
                child.tokens = child.tokens[same:]
                upper.below[child.tokens[0]] = child
                node.below[upper.tokens[0]] = upper
                child = upper
            node, at = child, at + same

    def link(self, member: int, size: int, tokens: tuple, groups: Groups) -> int:
        """Join ``member`` to every group that it links to; the number of sets that were compared.

        The walk carries the overlap of the tokens so far. A subtree is left out where even all that
        is left of its longest set would not make the overlap that its smallest set needs, or no size
        below fits; a set is left out where its group is joined already.
        """
        percent, own, compared = self.percent, frozenset(tokens), 0
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            if node.high * 100 < percent * size or node.low * percent > 100 * size:
                continue
            if not node.below and all(groups.root(m) == groups.root(member) for m, _ in node.ends):
                continue
            if node.tokens:
                compared += 1
                overlap += len(own.intersection(node.tokens))
            low = max(node.low, need(size, percent))
            if (100 + percent) * min(overlap + node.longest, len(own)) < percent * (size + low):
                continue
            for m, other in node.ends:
                if (100 + percent) * overlap >= percent * (size + other) and groups.root(m) != groups.root(member):
                    groups.join(m, member)
            todo += [(c, overlap) for c in node.below.values()]
        return compared


def _tokens(keys: bytes, classes: bytes) -> tuple:
    """Tokens in the global order: rare ones first, alike ones by value."""
    k, c = np.frombuffer(keys, np.uint64), np.frombuffer(classes, np.uint8)
    return tuple(k[np.lexsort((k, c))].tolist())


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links (class, class) that join what links within a block: ``asks`` rows are asked against ``held`` ones.

    Rows of one ``comp`` are joined from the start. Of each component only its first row is named.
    """
    members, sizes, comp, held, asks = (rows.column(c).to_pylist() for c in ("cls", "n", "comp", "held", "asks"))
    sets = [_tokens(k, c) for k, c in zip(rows.column("keys").to_pylist(), rows.column("classes").to_pylist(), strict=True)]
    order = sorted(range(len(members)), key=lambda r: members[r])
    rank = {r: k for k, r in enumerate(order)}
    groups, tree, first = Groups(len(members)), PrefixTree(percent), {}
    for k, r in enumerate(order):
        groups.join(k, first.setdefault(comp[r], k))
    for r in sorted(range(len(members)), key=lambda r: (not held[r], sizes[r], members[r])):
        if asks[r]:
            tree.link(rank[r], sizes[r], sets[r], groups)
        if held[r]:
            tree.add(rank[r], sizes[r], sets[r])
    pairs = [(members[order[k]], members[order[g]]) for k in first.values() if (g := groups.root(k)) != k]
    return pa.table({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})


#: 64-bit words of a set's sketch, and classes of one prefix token that are compared pair by pair.
SKETCH_WORDS, COMPARED = 8, 512
#: Sets of a block at most, so that its join stays short.
BLOCK_SETS = 512


def sketch(keys: np.ndarray) -> np.ndarray:
    """Parities: bit b tells whether an odd number of the keys falls on b, so two sets differ in at least as many keys as sketches in bits."""
    h = _mix(keys * np.uint64(_R))
    odd = np.bincount((h % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def plausible(token: np.ndarray, cls: np.ndarray, n: np.ndarray, shared: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (class, class) that join those classes of each token whose sizes and sketches do not rule a link out.

    Rows are sorted by token. Of sets with n keys, ``shared`` of which other documents hold, a link needs
    ceil(percent (n1 + n2) / (100 + percent)) common keys, so all others, the unshared ones among them, are few.
    """
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for d in range(1, len(token)):
        i = np.nonzero(token[:-d] == token[d:])[0]
        if not len(i):
            break
        j = i + d
        total, most = n[i] + n[j], np.maximum(n[i], n[j])
        odd = total - 2 * (-(-percent * total // (100 + percent))) - (total - shared[i] - shared[j])
        fit = (100 * (total - most) >= percent * most) & (np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= odd)
        left.append(i[fit])
        right.append(j[fit])
    i, j, least = np.concatenate(left), np.concatenate(right), np.arange(len(token))
    while True:
        low, before = np.minimum(least[i], least[j]), least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (least == before).all():
            break
    at = np.nonzero(least != np.arange(len(token)))[0]
    edges = np.unique(np.stack([cls[at], cls[least[at]]], 1), axis=0)
    return edges[:, 0], edges[:, 1]


def _family_links(rows: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links (u, v) that join the classes of each family that link, directly or over others.

    ``rows`` has cls, fam, n, keys and classes. A family of more than ``block_bytes`` or BLOCK_SETS is cut into blocks, by a band of
    sizes, as only sizes of neighbouring bands link, and a hash. First every block is joined with itself and
    with three hubs of its band and the one below, so near copies of each other find together at a cost that
    grows with the family alone. Then the classes outside their family's largest component, if there are any, are
    asked against the other blocks of their band and its neighbours. Links within a component are never needed.
    """
    place = rows.select("cls", "fam", F.floor(F.log(max(100 / percent, 1.0001) * (1 + 1e-9), "n")).cast("int").alias("band"), F.length("keys").alias("size"))
    bands = place.groupBy("fam", "band").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("sets"))
    whole = bands.groupBy("fam").agg(((F.sum("size") <= block_bytes) & (F.sum("sets") <= BLOCK_SETS)).alias("one"))
    parts = F.greatest(F.ceil(F.col("size") / block_bytes), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    bands = bands.join(whole, "fam").select("fam", "band", "one", F.when(F.col("one"), 0).otherwise(F.col("band") + 1).alias("row"), F.when(F.col("one"), 1).otherwise(parts).alias("parts"))
    block = F.col("row").cast("long") * (1 << 32) + F.pmod(F.xxhash64("cls"), F.col("parts"))
    place = stage(place.join(bands, ["fam", "band"]).select("cls", "fam", "one", "row", block.alias("blk")), "places")
    own = place.select("cls", "fam", "blk", F.col("cls").alias("comp"), F.lit(True).alias("held"), F.lit(True).alias("asks"))
    cut = place.where("not one")
    sets = rows.select("cls", "n", "keys", "classes")
    join = lambda t: _block_links(t, percent)
    if cut.isEmpty():
        return own.join(sets, "cls").groupBy("fam", "blk").applyInArrow(join, "u long, v long")
    hubs = cut.groupBy("fam", "row").agg(F.array_distinct(F.array(F.min("cls"), F.max("cls"), F.min_by("cls", F.xxhash64("cls")))).alias("hubs")).select("fam", F.explode(F.array("row", F.col("row") + 1)).alias("row"), F.explode("hubs").alias("cls"))
    blocks = cut.select("fam", "row", "blk").distinct()
    visits = hubs.join(blocks, ["fam", "row"]).join(place.select("cls", F.col("blk").alias("home")), "cls").where("blk <> home")
    visits = visits.select("cls", "fam", "blk", F.col("cls").alias("comp"), F.lit(True).alias("held"), F.lit(True).alias("asks"))
    links = stage(own.unionByName(visits).join(sets, "cls").groupBy("fam", "blk").applyInArrow(join, "u long, v long"), "block-links")
    joined = components(links)
    told = stage(cut.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "fam", "row", "blk", F.coalesce("component", "cls").alias("comp")), "told")
    largest = told.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("fam").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    rest = told.join(largest, "fam").where("comp <> largest").drop("largest")
    if rest.isEmpty():
        return links
    # the rest in groups of BLOCK_SETS; each meets every block of its band and the neighbouring ones but its own
    groups = rest.groupBy("fam").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("groups"))
    rest = rest.join(groups, "fam").withColumn("group", F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("groups")).cast("int"))
    met = rest.select("cls", "fam", F.col("blk").alias("home"), "comp", "group", F.explode(F.array(F.col("row") - 1, "row", F.col("row") + 1)).alias("row")).join(blocks, ["fam", "row"]).where("blk <> home")
    asked = met.select("cls", "fam", "blk", "group", "comp", F.lit(False).alias("held"), F.lit(True).alias("asks"))
    tasks = met.select("fam", "blk", "group").distinct()
    given = told.join(tasks, ["fam", "blk"]).select("cls", "fam", "blk", "group", "comp", F.lit(True).alias("held"), F.lit(False).alias("asks"))
    more = asked.unionByName(given).join(sets, "cls").groupBy("fam", "blk", "group").applyInArrow(join, "u long, v long")
    return links.unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))).unionByName(more)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for each row of ``docs`` (doc_id, text) with a doc_id.

    Two documents link where 100 * intersection >= ``percent`` * union of their sets of word shingles
    (see ``shingles``); component_id is the smallest doc_id that links reach. Documents without words link to
    none. Repeated rows have equal sets and so one component. Rows with a null doc_id are left out.

    Equal sets become one class. Shingles that no other document holds only count; a class whose
    other shingles are too few for a link is done. The rest are joined: a linked pair shares a token
    in its prefixes (rarest first) and differs in few keys, so families are the components of classes that share one and whose
    sketches differ little enough; unrelated documents with a common phrase don't become one family. Tokens of more than
    COMPARED classes join these without a look at sketches. Families are joined in blocks (see ``_family_links``), each one
    task's prefix-tree join, which yields groups, never pairs. No family or block is dropped.

    A very long text is one chunk's keys in one task, and later one set; sketches rule out pairs of sets up to about 1,500
    shingles, beyond which sharing a prefix token makes a family.
    """
    found = stage(shared_keys(docs, lambda t: shingles(t, words), percent / 100), "shingles")
    held = found.where("keys is not null and n > 0")
    classes = held.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("cls"))
    sets = held.join(classes, ["n", "h1", "h2"]).where("doc_id = cls").dropDuplicates(["cls", "h1", "h2", "n"]).select("cls", F.col("n"), "keys", "classes")
    sets = stage(sets, "classes")

    def prefixes(batches):
        for b in batches:
            cls, token = [], []
            for c, n, k, z in zip(*(b.column(x).to_pylist() for x in ("cls", "n", "keys", "classes")), strict=True):
                t = _tokens(k, z)[: max(0, n - need(n, percent) + 1 - (n - len(k) // 8))]
                token.append(np.array(t, np.uint64).astype(np.int64))
                cls.append(np.full(len(t), c, np.int64))
            yield pa.RecordBatch.from_pydict({"cls": np.concatenate(cls) if cls else np.zeros(0, np.int64), "token": np.concatenate(token) if token else np.zeros(0, np.int64)})

    prefix = stage(sets.mapInArrow(prefixes, "cls long, token long"), "prefixes")
    stars = prefix.groupBy("token").agg(F.min("cls").alias("v"), F.max("cls").alias("w"), F.count(F.lit(1)).alias("c")).where("v < w").select("token", "v", "c")
    meeting = prefix.join(stars, "token")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(k, np.uint64) for k in b.column("keys").to_pylist()]
            yield pa.RecordBatch.from_pydict({"cls": b.column("cls"), "n": b.column("n"), "shared": pa.array([len(k) for k in keys], pa.int64()), "bits": pa.array([sketch(k).tobytes() for k in keys], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            token = held.column("token").to_numpy()
            last = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last token's rows may go on
            if last:
                yield from links(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield from links(held)

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, cls, n, shared = (rows.column(c).to_numpy() for c in ("token", "cls", "n", "shared"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
        u, v = plausible(token, cls, n, shared, bits, percent)
        yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    few = meeting.where(F.col("c") <= COMPARED).select("token", "cls").join(sets.select("cls", "n", "keys").mapInArrow(sketches, "cls long, n long, shared long, bits binary"), "cls")
    near = few.repartition("token").sortWithinPartitions("token").mapInArrow(compare, "u long, v long")
    family = components(near.unionByName(meeting.where((F.col("c") > COMPARED) & (F.col("cls") != F.col("v"))).select(F.col("cls").alias("u"), "v")))
    rows = sets.join(family.withColumnRenamed("node", "cls").withColumnRenamed("component", "fam"), "cls")
    links = stage(_family_links(rows, percent, block_bytes), "links")
    linked = components(links)
    per_class = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("n", "h1", "h2", F.coalesce("component", "cls").alias("component_id"))
    out = found.select("doc_id", "text_key", "n", "h1", "h2").join(per_class, ["n", "h1", "h2"], "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
