"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places on the ring, and parts that the keys of a place are ranked in. Counts are taken and spilled over by
#: place and part, so the driver handles at most PLACES * SUBS numbers at any input size.
PLACES, SUBS = 1 << 13, 8


def ring(shards: int, virtual: int, places: int = PLACES) -> list[list[int]]:
    """For each virtual node on the ring, clockwise: [place, shard]. A shard's places don't depend on the other shards."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            place = int.from_bytes(hashlib.blake2b(b"%d:%d" % (shard, v), digest_size=8).digest(), "big") % places
            at.setdefault(place, shard)
    if len(set(at.values())) < shards:
        raise ValueError("more shards than the ring has room for; use fewer shards or more virtual nodes")
    return [[p, at[p]] for p in sorted(at)]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard takes. No slack: they sum to ``rows`` and are at most one apart."""
    if slack:
        return [ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place_counts(counts: dict[int, int], shards: int, virtual: int = 64, slack: float = 0.0, places: int = PLACES) -> list[tuple[int, int, int, int, int]]:
    """Runs (place, low, high, shard, slot): a place's keys low..high-1, in their order, go to the shard's slots from ``slot`` on.

    First every place's keys go to the next virtual node's shard as far as it has room, places
    clockwise; what is left walks on clockwise until it meets shards with room.
    """
    nodes = ring(shards, virtual, places)
    room, used = capacities(sum(counts.values()), shards, slack), [0] * shards
    runs: list[tuple[int, int, int, int, int]] = []
    done: dict[int, int] = defaultdict(int)

    def take(place: int, shard: int) -> None:
        n = min(counts[place] - done[place], room[shard] - used[shard])
        if n > 0:
            runs.append((place, done[place], done[place] + n, shard, used[shard]))
            done[place] += n
            used[shard] += n

    home, k = {}, 0
    for place in sorted(counts):
        while k < len(nodes) and nodes[k][0] < place:
            k += 1
        home[place] = k % len(nodes)
        take(place, nodes[home[place]][1])
    for place in sorted(counts):
        step = home[place]
        while done[place] < counts[place]:
            step = (step + 1) % len(nodes)
            take(place, nodes[step][1])
    return runs


def shard_rows(df: DataFrame, key: Column, shards: int, ties: list[Column], virtual: int = 64, slack: float = 0.0, places: int = PLACES, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with its shard (int) and its slot there (long, gapless from 0).

    A key's hash is its place on the ring. Rows of one place are ordered by the key's hash and
    ``ties``; rows equal in all of these are interchangeable. Null keys hash like any other. With no
    slack, shards' row counts are at most one apart; else none exceeds (1 + slack) times the mean.

    One small aggregation gives the rows of each place (at most PLACES * SUBS numbers for the driver),
    and one shuffle of the rows ranks them. A key that many rows share is cut over SUBS sub-ranks by
    ``ties``. Of the columns only the key and ``ties`` are looked at, so a long text costs its way through that one shuffle, or nothing if
    it is left out of ``df``. Empty table: no rows. Existing columns called like the new ones are replaced.
    """
    spark = df.sparkSession
    h = F.xxhash64(key)
    sub = F.pmod(F.xxhash64(h, *ties), F.lit(SUBS)).cast("int")
    rows = df.drop(shard_col, slot_col).withColumns({"__h": h, "__place": F.shiftrightunsigned(h, 64 - (places.bit_length() - 1)).cast("int"), "__sub": sub})
    by_sub = {(r[0], r[1]): r[2] for r in rows.groupBy("__place", "__sub").count().collect()}
    counts: dict[int, int] = defaultdict(int)
    base = []
    for place, s in sorted(by_sub):
        base.append((place, s, counts[place]))
        counts[place] += by_sub[place, s]
    runs = place_counts(counts, shards, virtual, slack, places)
    pieces = defaultdict(list)
    for place, low, high, shard, slot in runs:
        pieces[place].append((low, high, shard, slot))
    segments = [(p, s, max(0, low - b), min(high, b + by_sub[p, s]) - b, shard, slot + max(0, b - low)) for p, s, b in base for low, high, shard, slot in pieces[p] if low < b + by_sub[p, s] and high > b]
    told = spark.createDataFrame(segments, "__place int, __sub int, __low long, __high long, __shard int, __slot long")
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__place", "__sub").orderBy("__h", *ties)).cast("long") - 1)
    joined = ranked.join(F.broadcast(told), (ranked["__place"] == told["__place"]) & (ranked["__sub"] == told["__sub"]) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    return joined.select(*[ranked[c] for c in kept], F.col("__shard").alias(shard_col), (F.col("__slot") + F.col("__rank") - F.col("__low")).alias(slot_col))
