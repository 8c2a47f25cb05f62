"""Exact top-k inner-product search by a dual-tree walk over cover trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

#: Points of a leaf, queries of a leaf, and the centres that a ball is split over at most.
LEAF, QUERY_LEAF, FANOUT = 256, 64, 24


def quantized(vector: str | Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null for a vector that is null, empty or holds null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class CoverTree:
    """Nested balls around points: each child's ball covers its own points, and its centre is one of them.

    A ball is split by its farthest points in turn until centres cover it within half its radius, or
    there are FANOUT, or fewer where that would make leaves too small; every point goes to its nearest centre. A ball of at most ``leaf`` points is split only where a quarter of
    its radius covers some of them (near copies), so that these can be told apart from the others; balls of equal points never are. Node i holds the rows order[low[i]:high[i]]; its children are the nodes
    from first[i] on, kids[i] of them. ``radius`` is the true distance of its farthest point,
    ``angle`` the widest angle at the origin between its centre and a point (half a turn where either is zero), ``norm`` its centre's
    length, ``top`` the length of its longest point.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        points = points.astype(np.float64)
        norms = np.sqrt((points**2).sum(1))
        self.order = np.arange(len(points))
        own = [int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))]
        low, high, first, kids, radius, angle = [0], [len(points)], [0], [0], [], []
        scale = np.where(norms > 0, norms, 1)[:, None]
        unit = np.where(norms[:, None] > 0, points / scale, np.nan)
        for i in _counter(own):
            rows = self.order[low[i] : high[i]].copy()
            near = np.sqrt(((points[rows] - points[own[i]]) ** 2).sum(1))
            radius.append(float(near.max()))
            angle.append(float(np.nan_to_num(np.arccos(np.clip(unit[rows] @ unit[own[i]], -1, 1)), nan=np.pi).max()))
            if radius[i] == 0:
                continue
            if len(rows) <= leaf:
                centers, owner = _dense(points[rows], rows, radius[i] / 4)
                if len(centers) < 2:
                    continue
                near[:] = 0
            else:
                centers, owner = [own[i]], np.zeros(len(rows), int)
            most = min(FANOUT, len(rows) // leaf + 1)
            while near.max() > radius[i] / 2 and len(centers) < most:
                far = int(rows[near.argmax()])
                d = np.sqrt(((points[rows] - points[far]) ** 2).sum(1))
                owner[d < near] = len(centers)
                near = np.minimum(near, d)
                centers.append(far)
            self.order[low[i] : high[i]] = rows[np.argsort(owner, kind="stable")]
            sizes = np.bincount(owner, minlength=len(centers))
            ends = low[i] + np.cumsum(sizes)
            first[i], kids[i] = len(own), len(centers)
            own += centers
            low += (ends - sizes).tolist()
            high += ends.tolist()
            first += [0] * len(centers)
            kids += [0] * len(centers)
        self.low, self.high, self.first, self.kids, self.radius = map(np.array, (low, high, first, kids, radius))
        self.angle = np.array(angle) + 1e-7
        self.center, self.norm, self.unit = points[own], norms[own], np.nan_to_num(unit[own])
        self.top = np.array([norms[self.order[a:b]].max() for a, b in zip(low, high, strict=True)])

    def children(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(f, f + n) for f, n in zip(self.first[nodes].tolist(), self.kids[nodes].tolist(), strict=True)])

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[a:b] for a, b in zip(self.low[nodes].tolist(), self.high[nodes].tolist(), strict=True)])


def _dense(points: np.ndarray, rows: np.ndarray, reach: float, least: int = 4) -> tuple[list[int], np.ndarray]:
    """Centres, and each row's centre: balls of radius ``reach`` with at least ``least`` points, the fullest first, and one for the rest."""
    size = (points**2).sum(1)
    near = size[:, None] + size[None, :] - 2 * points @ points.T <= reach * reach
    centers, owner, left = [], np.full(len(rows), -1), np.ones(len(rows), bool)
    while left.any():
        full = (near & left[None, :]).sum(1) * left
        at = int(full.argmax())
        mine = near[at] & left if full[at] >= least else left.copy()
        mine[at] = True
        owner[mine], left = len(centers), left & ~mine
        centers.append(int(rows[at]))
    return centers, owner


def _counter(growing: list) -> Iterator[int]:
    """Positions of a list that grows meanwhile."""
    i = 0
    while i < len(growing):
        yield i
        i += 1


class TopK:
    """The best k of each query so far, by score, then smaller id; an id counts once for each of its scores.

    ``known`` are scores that each query's k-th best reaches in any case; below them nothing is kept.
    """

    def __init__(self, ids: np.ndarray, k: int, known: np.ndarray | None = None) -> None:
        self.ids, self.k = ids, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.worst = np.full(len(ids), -np.inf) if known is None else known.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the queries ``rows`` against the points ``ids``."""
        scores = np.where(ids[None, :] == self.ids[rows][:, None], -np.inf, scores) if scores.dtype != object else scores
        floor = self.worst[rows]
        one = np.unique(ids, return_index=True)[1]  # k different ids reach the floor, so k different entries do
        if scores.dtype != object and len(one) > self.k:
            alone = scores if len(one) == len(ids) else scores[:, one]
            floor = np.maximum(floor, np.partition(alone, len(one) - self.k, axis=1)[:, len(one) - self.k])
        for i in np.nonzero((scores >= floor[:, None]).any(axis=1))[0]:
            hit = np.nonzero((scores[i] >= floor[i]) & (ids != self.ids[rows[i]]))[0]
            s, d = (np.concatenate([a, b]) for a, b in zip(self.best[rows[i]], (scores[i, hit].astype(np.int64), ids[hit]), strict=True))
            first = np.lexsort((d, -s))
            s, d = s[first], d[first]
            first = np.nonzero(np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])][: len(s)])[0][: self.k]
            self.best[rows[i]] = s[first], d[first]
            if len(first) == self.k:
                self.worst[rows[i]] = max(self.worst[rows[i]], s[first[-1]])


def number_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type that holds every partial sum of an inner product exactly."""
    most = max((np.abs(x).astype(np.float64) ** 2).sum(1).max(initial=0) for x in (a, b))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Search:
    """Walks a query tree and a point tree together.

    A query node meets an array of point nodes. Of a pair with centres q and p and radii rq and rp no
    inner product exceeds <q, p> + rq |p| + rp |q| + rq rp, nor half of what the squares of the longest
    query and the longest point have over that of the gap |q - p| - rq - rp between the balls, nor the product of these lengths and
    the cosine of the angle left between the two cones (0 at least). Pairs whose bound is
    below the worst k-th score of the node's queries are left out with all they hold; where the
    point ball is the wider one it is opened, else the query ball. Leaves are scored by falling bound.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, tree: CoverTree | None = None, known: np.ndarray | None = None) -> None:
        self.queries, self.tree, self.top = queries, tree or CoverTree(queries, QUERY_LEAF), TopK(query_ids, k, known)
        self.pruned = self.scored = self.points_pruned = self.points_scored = 0

    def add(self, points: np.ndarray, ids: np.ndarray, tree: CoverTree | None = None) -> None:
        asked, tree = self.tree, tree or CoverTree(points)
        kind = number_type(self.queries, points)
        q, p = self.queries.astype(kind), points.astype(kind)
        todo = [(0, np.zeros(1, int))]
        while todo:
            a, nodes = todo.pop()
            rows = asked.order[asked.low[a] : asked.high[a]]
            bound = self._bounds(a, nodes, tree)
            fit = bound >= self.top.worst[rows].min()
            self._leave(tree, nodes[~fit], rows)
            nodes, bound = nodes[fit], bound[fit]
            open_ = (tree.kids[nodes] > 0) & ((tree.radius[nodes] >= asked.radius[a]) | (asked.kids[a] == 0))
            if open_.any():
                todo.append((a, np.concatenate([nodes[~open_], tree.children(nodes[open_])])))
            elif asked.kids[a] and len(nodes):
                todo += [(int(c), nodes) for c in asked.children(np.array([a]))]
            else:
                first = np.argsort(-bound, kind="stable")
                nodes, bound, at, n = nodes[first], bound[first], 0, 1
                while at < len(nodes):
                    if bound[at] < self.top.worst[rows].min():
                        self._leave(tree, nodes[at:], rows)
                        break
                    part = nodes[at : at + n]
                    cols = tree.rows(part)
                    live = rows[bound[at] >= self.top.worst[rows]]
                    for r in range(0, len(live), 512):
                        for c in range(0, len(cols), 8192):
                            some = cols[c : c + 8192]
                            self.top.add(live[r : r + 512], q[live[r : r + 512]] @ p[some].T, ids[some])
                    self.scored += len(part)
                    self.points_scored += len(cols) * len(live)
                    self.points_pruned += len(cols) * (len(rows) - len(live))
                    at, n = at + n, 2 * n

    def _leave(self, tree: CoverTree, nodes: np.ndarray, rows: np.ndarray) -> None:
        self.pruned += len(nodes)
        self.points_pruned += int((tree.high[nodes] - tree.low[nodes]).sum()) * len(rows)

    def _bounds(self, a: int, nodes: np.ndarray, tree: CoverTree) -> np.ndarray:
        r, m, rp, mp = self.tree.radius[a], self.tree.norm[a], tree.radius[nodes], tree.norm[nodes]
        inner = tree.center[nodes] @ self.tree.center[a]
        size = self.tree.top[a] ** 2 + tree.top[nodes] ** 2
        gap = np.maximum(0, np.sqrt(np.maximum(0, m * m + mp * mp - 2 * inner)) - r - rp)
        turn = np.arccos(np.clip(tree.unit[nodes] @ self.tree.unit[a], -1, 1)) - self.tree.angle[a] - tree.angle[nodes]
        wide = self.tree.top[a] * tree.top[nodes] * np.maximum(0, np.cos(np.clip(turn, 0, np.pi)))
        bound = np.minimum(np.minimum(inner + r * mp + rp * m + r * rp, (size - gap * gap) / 2), wide)
        return bound + 1e-7 * (1 + size)  # rounding never prunes


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    most = int(np.abs(v).max(initial=0))
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def indexed(points: DataFrame, block_rows: int, first_blocks: int, growth: int) -> tuple[DataFrame, int]:
    """Every point of ``points`` (vec_id, v) in blocks of one dimension with their cover trees, and the number of rounds.

    One row a block: round, block (pickled ids, points and tree). A hash deals blocks to rounds: the first
    gets about ``first_blocks``, each later one ``growth`` times as many as all before it.
    """
    blocks = max(1, -(-points.count() // block_rows))
    shares = [1.0]
    while shares[0] * blocks > first_blocks:
        shares.insert(0, shares[0] / (1 + growth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        task, made = TaskContext.get().partitionId(), 0

        def block(d: int) -> pa.RecordBatch:
            nonlocal made
            ids, vs = zip(*held.pop(d), strict=True)
            v, made = np.array(vs, np.int64), made + 1
            turn = ((task * 1_000_003 + made) * 0x9E3779B97F4A7C15 >> 11) % (1 << 32) / (1 << 32)
            data = pickle.dumps((np.array(ids, np.int64), _narrow(v), CoverTree(v)), 5)
            return pa.RecordBatch.from_pydict({"round": pa.array([next(i for i, x in enumerate(shares) if turn < x)], pa.int32()), "block": pa.array([data], pa.binary())})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = held.setdefault(len(v), {})
                rows[i, tuple(v)] = True
                if len(rows) >= block_rows:
                    yield block(len(v))
        for d in list(held):
            yield block(d)

    index = points.coalesce(blocks).mapInArrow(run, "round int, block binary")
    return stage(index, "points", ["round"]), len(shares)


def top_k(points: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 8192, query_bytes: int = 16 << 20, first_blocks: int = 64, growth: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k greatest inner products, ties to the smaller vec_id.

    ``points`` and ``queries`` hold vec_id (long) and v (array<long>, see ``quantized``). Rows with a null
    id or vector take no part, equal rows count once, and a query never meets rows of its own id or of
    another dimension. With fewer than k candidates a query gets them all; a query id with
    several vectors gets the best k over them. An empty side gives no rows.

    Every point is indexed once, in blocks of ``block_rows`` with a tree each, and every query, in groups of at most
    about ``query_bytes`` with a tree each. A group is broadcast and walked against the blocks in rounds
    (see ``indexed``). After each round but the last one a query's k-th score so far goes along, so all tasks of the next round prune
    by it and send only what reaches it: about k * ``growth`` rows a query and round at any size, not k a task.
    """
    spark = points.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long"), "v").where("vec_id is not null and v is not null")
    asked = clean(queries).distinct()
    sizes = asked.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    groups = max(1, -(-8 * (sizes[1] or 0) // query_bytes))
    asked = stage(asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "queries", ["group"])
    index, rounds = indexed(clean(points), block_rows, first_blocks, growth)
    out = None
    for g in range(groups):
        by_dim: dict[int, tuple[list, list]] = {}
        for i, v in asked.where(F.col("group") == g).select("vec_id", "v").collect():
            ids, vs = by_dim.setdefault(len(v), ([], []))
            ids.append(i)
            vs.append(v)
        trees = {d: (np.array(vs, np.int64), np.array(ids, np.int64), CoverTree(np.array(vs, np.int64), QUERY_LEAF)) for d, (ids, vs) in by_dim.items()}
        known: dict[int, float] = {}
        best = None
        for r in range(rounds):
            told = spark.sparkContext.broadcast({d: (*t, np.array([known.get(i, -np.inf) for i in t[1].tolist()])) for d, t in trees.items()})

            def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
                search = {d: Search(q, ids, k, tree, seen) for d, (q, ids, tree, seen) in told.value.items()}
                for batch in batches:
                    for row in batch.column(0):
                        ids, v, tree = pickle.loads(row.as_py())
                        if v.shape[1] in search:
                            search[v.shape[1]].add(v, ids, tree)
                for s in search.values():
                    for at in range(0, len(s.top.ids), 1000):
                        part = s.top.best[at : at + 1000]
                        n = [len(x) for x, _ in part]
                        if sum(n):
                            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(s.top.ids[at : at + 1000], n), "vec_id": np.concatenate([x for _, x in part]), "score": np.concatenate([x for x, _ in part])})

            found = index.where(F.col("round") == r).select("block").mapInArrow(run, "query_id long, vec_id long, score long")
            best = _ranked(found if best is None else best.select("query_id", "vec_id", "score").unionByName(found), k)
            if r < rounds - 1:
                best = stage(best, "best")
                known = {i: float(s) for i, s in best.where(F.col("rank") == k).select("query_id", "score").collect()}
        out = best if out is None else out.unionByName(best)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best different rows of each query: one shuffle, by query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.repartition("query_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: top_k() over ``embeddings``, for DuckDB.
SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
