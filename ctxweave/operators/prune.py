"""Dropping lines of little weight."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_filler, prune_words, raw_words, trimmed
from ..functions.tokens import TokenCounter, bytes4
from ..staging import drop_shuffles, stage
from .chunks import is_protected, is_small, per_context
from .overlap import ROW_GROUP, inside_fences, met_by_blocks

#: What a chunk becomes that keeps no visible line.
PLACEHOLDER = "[earlier context summarized]"


#: Contexts of up to so many chunks and bytes are compared in one group, larger ones block by block.
SMALL, SMALL_BYTES = 2000, 32 << 20
#: Meetings of a line's words and earlier chunks that are counted at once.
MEETINGS = 1 << 22
#: What is known of large contexts' lines is sent to all tasks up to so many bytes, else joined.
TOLD_BYTES = 96 << 20


def _words() -> Column:
    """For each line its distinct content words, hashed (h), how many there are with repeats (n), and whether it is a fence."""
    return F.transform(F.split("content", "\n"), lambda line: F.transform(F.array(prune_words(line)), lambda ws: F.struct(F.transform(F.array_distinct(ws), lambda w: F.xxhash64(w)).alias("h"), F.size(ws).alias("n"), (F.contains(line, F.lit("```")) & trimmed(line).startswith("```")).alias("fence")))[0])


def _marked(chunks: DataFrame) -> DataFrame:
    """Chunks with ``__protected`` and ``__n``, the size of their context."""
    return chunks.withColumns({"__protected": is_protected(), "__n": F.count(F.lit(1)).over(per_context())})


def _most_shared(chunk_of_line: np.ndarray, line: np.ndarray, word: np.ndarray, chunks: int) -> np.ndarray:
    """For each line the most words that it shares with one earlier chunk; ``line`` and ``word`` are its distinct words, line after line."""
    most = np.zeros(len(chunk_of_line), np.int32)
    if not len(word):
        return most
    own = chunk_of_line[line]
    word = np.unique(word, return_inverse=True)[1]
    held = np.unique(word * chunks + own)  # each word's chunks in order
    start, stop = np.searchsorted(held, word * chunks), np.searchsorted(held, word * chunks + own)
    n = stop - start
    group = np.cumsum(np.bincount(line, n, len(most)) + chunks) // MEETINGS
    edges = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(most)]
    for low, high in zip(edges, edges[1:], strict=False):
        a, b = np.searchsorted(line, [low, high])
        m = n[a:b]
        chunk = held[np.repeat(start[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)] % chunks
        shared = np.bincount(np.repeat(line[a:b] - low, m) * chunks + chunk, minlength=(high - low) * chunks)
        most[low:high] = shared.reshape(-1, chunks).max(1)
    return most


_FACTS = pa.struct([("kept", pa.int32()), ("inside", pa.bool_()), ("overlap", pa.float64())])


def _facts_in_context(rows: pa.Table) -> pa.Table:
    """``rows`` of one context with ``__facts`` for ``__words``: the overlap of a line is the largest share of its words that one earlier chunk has too."""
    rows = rows.take(np.argsort(rows.column("pos").to_numpy(), kind="stable"))
    lines = rows.column("__words").combine_chunks()
    lines = lines.chunk(0) if isinstance(lines, pa.ChunkedArray) else lines
    per_chunk = np.diff(lines.offsets.to_numpy())
    flat = lines.flatten()
    hashes = flat.field("h")
    own = np.diff(hashes.offsets.to_numpy())
    chunk_of_line = np.repeat(np.arange(len(rows)), per_chunk)
    line = np.repeat(np.arange(len(chunk_of_line)), own)
    most = _most_shared(chunk_of_line, line, hashes.flatten().to_numpy(zero_copy_only=False), max(1, len(rows)))
    inside = inside_fences(flat.field("fence").to_numpy(zero_copy_only=False).astype(bool), per_chunk)
    facts = pa.StructArray.from_arrays([flat.field("n"), pa.array(inside), pa.array(most / np.maximum(own, 1))], fields=list(_FACTS))
    ends = np.r_[0, np.cumsum(per_chunk)].astype(np.int32)
    return rows.drop_columns("__words").append_column("__facts", pa.ListArray.from_arrays(pa.array(ends), facts))


def _few(chunks: DataFrame) -> DataFrame:
    """Chunks of small contexts with their lines' facts, each context in one group where its windows have brought it."""
    marked = _marked(chunks)
    line = T.StructType([T.StructField("kept", T.IntegerType()), T.StructField("inside", T.BooleanType()), T.StructField("overlap", T.DoubleType())])
    schema = T.StructType([*marked.schema.fields, T.StructField("__facts", T.ArrayType(line))])
    return marked.withColumn("__words", _words()).groupBy("ctx_id").applyInArrow(_facts_in_context, schema)


def _many(chunks: DataFrame, ids: list[int | None]) -> DataFrame:
    """Chunks of large contexts with their lines' facts; an overlap stands for all that score alike. Chunks are staged, and so are their words for a while."""
    number = F.create_map(*[F.lit(x) for i, c in enumerate(ids) if c is not None for x in (c, i)]) if set(ids) - {None} else None
    c = F.lit(ids.index(None) if None in ids else None).cast("int")
    c = c if number is None else F.when(F.col("ctx_id").isNull(), c).otherwise(F.try_element_at(number, F.col("ctx_id")))
    held = stage(_marked(chunks).withColumn("__c", c), "prune-chunks", row_group=ROW_GROUP)
    drop_shuffles(chunks.sparkSession)  # as much as all texts, and staged now
    found, size = met_by_blocks(held.select(F.col("__c").alias("c"), "pos", _words().alias("words")))
    found = found.select(F.col("c").alias("__c"), "pos", F.col("told").alias("__told"))
    facts = F.transform("__told", lambda x: F.struct(F.floor(x / 6).cast("int").alias("kept"), (x % 6 >= 3).alias("inside"), F.when(x % 3 == 2, 0.8).when(x % 3 == 1, 0.6).otherwise(0.0).alias("overlap")))
    told = held.join(F.broadcast(found) if size <= TOLD_BYTES else found.hint("shuffle_hash"), ["__c", "pos"])  # texts are not sorted for it
    return told.select(*[c for c in held.columns if c != "__c"], facts.alias("__facts"))


def _with_facts(chunks: DataFrame) -> DataFrame:
    """Chunks with ``__protected``, ``__n`` and ``__facts``: of each line kept (content words), inside (a fence or in one) and overlap."""
    chunks = chunks.withColumn("content", F.coalesce("content", F.lit("")))
    if SMALL > 0 and is_small(chunks):  # then no context can be too large for a group
        return _few(chunks)
    sizes = chunks.groupBy("ctx_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    large = (F.col("n") > SMALL) | (F.col("bytes") > SMALL_BYTES)
    seen = sizes.agg(F.collect_list(F.when(large, F.struct("ctx_id"))).alias("large"), F.count_if(~large).alias("others")).first()
    ids = [r.ctx_id for r in seen.large]
    if not ids:
        return _few(chunks)
    if not seen.others:
        return _many(chunks, ids)
    here = F.coalesce(F.col("ctx_id").isin([i for i in ids if i is not None]), F.lit(None in ids))
    return _few(chunks.where(~here)).unionByName(_many(chunks.where(here), ids))


def _lines(chunks: DataFrame) -> DataFrame:
    """Chunks with ``__protected`` and ``__lines``: each line, whether it may go (open), and its score; all of it within the row."""
    given = F.arrays_zip(F.split("content", "\n").alias("line"), F.col("__facts").alias("f"))
    told = F.transform(given, lambda x: F.struct(x["line"].alias("line"), x["f"]["kept"].alias("kept"), x["f"]["inside"].alias("inside"), x["f"]["overlap"].alias("overlap"), trimmed(x["line"]).alias("bare"), F.size(raw_words(x["line"])).alias("n_words"), is_filler(x["line"]).alias("filler")))
    scored = F.transform(told, lambda x: F.struct(x["line"].alias("line"), (~F.col("__protected") & ~x["inside"] & (x["bare"] != "")).alias("open"), line_score(x).alias("score")))
    return _with_facts(chunks).withColumn("__lines", scored)


def line_score(x: Column) -> Column:
    """0 to 1 from role, pos and __n of a chunk, and bare, kept, n_words, filler and overlap of its line ``x``; higher: keep."""
    n_words, bare, n = x["n_words"], x["bare"], F.col("__n")
    stop_ratio = 1 - x["kept"] / F.greatest(n_words, F.lit(1))
    stop = F.when(stop_ratio > 0.7, 0.1).when(stop_ratio > 0.6, 0.3).otherwise(0.8)
    repeated = F.when(x["overlap"] > 0.7, 0.1).when(x["overlap"] > 0.5, 0.4).otherwise(0.9)
    heading = bare.startswith("#")
    listed = bare.startswith("- ") | bare.startswith("* ") | bare.startswith("1.")
    shape = F.when(heading, 1.0).when(listed, 0.7).when(F.col("role") == "assistant", 0.6).otherwise(0.65)
    filler = x["filler"]
    length = F.when((n_words < 4) & ~heading, 0.2).when(n_words < 8, 0.5).otherwise(0.9)
    recency = F.when(n <= 1, 0.5).otherwise(0.3 + F.col("pos") / F.greatest(n - 1, F.lit(1)) * 0.7)
    factor = F.when(filler & (n_words < 8), 0.1).when((stop <= 0.3) & (n_words < 6), 0.1).otherwise(1.0)
    raw = stop * 0.20 + repeated * 0.20 + shape * 0.10 + F.when(filler, 0.1).otherwise(0.9) * 0.20 + length * 0.15 + recency * 0.10
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * factor))


def line_scores(chunks: DataFrame) -> DataFrame:
    """ctx_id, pos, line_no, line, score of every line that pruning may drop: unprotected, outside fences, not blank.

    Contexts of more than SMALL chunks or SMALL_BYTES bytes are compared at once, by jobs of their own.
    """
    # no column that scores don't need goes through windows; the outer form, as for the inner one Spark would score all lines once more to filter by their count
    out = _lines(chunks.select("ctx_id", "pos", "role", "content")).select("ctx_id", "pos", F.posexplode_outer("__lines").alias("line_no", "x"))
    return out.where("x.open").select("ctx_id", "pos", "line_no", "x.line", "x.score")


def prune(chunks: DataFrame, threshold: float = 0.3, counter: TokenCounter = bytes4) -> DataFrame:
    """Chunks without the lines that score below ``threshold``; system rows and the last two user rows stay as they are.

    No chunk goes: one without a visible line left holds PLACEHOLDER. Contexts without an id go as one. Lines go within their row,
    without another shuffle; large contexts are compared at once, by jobs of their own.
    """
    left = F.filter("__lines", lambda x: ~(x["open"] & (x["score"] < threshold)))
    out = _lines(chunks).withColumn("__kept", F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    text = F.when(F.col("__protected"), F.col("content")).when(trimmed("__kept") == "", PLACEHOLDER).otherwise(F.col("__kept"))
    out = out.withColumn("content", text)
    return out.withColumn("token_count", F.when(F.col("__protected"), F.col("token_count")).otherwise(counter(F.col("content")))).select(*chunks.columns)
