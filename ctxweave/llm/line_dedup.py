"""Dropping lines that many documents share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: What is stripped from both ends of a line before it is compared: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(SPACE))
    # lower() is much the faster one, and in a line of ASCII alone it changes the same letters
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hash(key: Column) -> Column:
    """128 bits of a line's key as two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _filled(key: Column) -> Column:
    return F.when(key != "", _hash(key))


def _without(lines: Column, gone: Column) -> Column:
    """The lines joined without those at the sorted positions ``gone``, in time that grows with both alone."""
    bounds = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.size(lines))).alias("b"))
    kept = F.transform(F.array(lines), lambda ls: F.flatten(F.transform(bounds, lambda z: F.slice(ls, z["a"] + 2, z["b"] - z["a"] - 1))))
    return F.array_join(F.element_at(kept, 1), "\n")


def shared_lines(docs: DataFrame, min_docs: int, text: str = "text", doc: str | None = None) -> DataFrame:
    """Hashes (a, b) of the line keys that at least ``min_docs`` documents hold.

    Every row is a document of its own, or with ``doc`` rows of one id in that column are one document
    and null ids don't count. A row counts once for each of its keys, and counts are summed before the shuffle,
    so a line that a third of all rows share costs one record for each task. Only where ids are repeated
    or null are lines first grouped by hash and id, which spreads such a line by its ids.
    """
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n", -1), line_key))  # strings go through a hash set, structs would be compared one by one
    hashes = F.transform(F.filter(keys, lambda k: k != ""), _hash)
    lines = docs.select(F.explode(hashes).alias("h"))
    if doc and not docs.groupBy(F.col(doc).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or d is null").isEmpty():
        lines = docs.where(F.col(doc).isNotNull()).select(F.explode(hashes).alias("h"), F.col(doc).alias("d")).distinct()
    return lines.groupBy("h.a", "h.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b")


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", broadcast_rows: int = 200_000, doc: str | None = None) -> DataFrame:
    """``docs`` with lines that at least ``min_docs`` documents share dropped from ``text``.

    Adds ``n_lines`` (before dropping) and ``n_dropped``; a row that loses every line keeps an empty
    text. Lines are split at \\n alone and joined by it; empty keys never drop. Null text is one empty
    line and becomes an empty text. Every row is a document of its own, also a repeated one, unless ``doc``
    names the column of documents' ids (see ``shared_lines``); rows come out one to one either way.

    A text of very many lines takes time in proportion (and to sort its keys); its lines are in memory at once, as the text is.
    Columns of map or variant type take no part in telling repeated rows apart, which costs evenness only.

    The shared lines are written once. Up to ``broadcast_rows`` of them (32 bytes each) are
    broadcast, more are shuffled; either way only positions to be dropped are then grouped by row
    (its text and other columns, so copies are spread), and rows with nothing to drop meet an empty side.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"] or [F.lit(0)]
    rows = docs.withColumns({text: whole, "__t": F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"), F.xxhash64(*others).alias("row"))})
    shared = stage(shared_lines(docs, min_docs, text, doc), "shared-lines")
    found = shared.count()
    if not found:
        out = rows.withColumn("__at", F.lit(None).cast("array<int>"))
    else:
        side = F.broadcast(shared) if found <= broadcast_rows else shared
        lines = rows.select("__t", F.posexplode(F.transform(F.split(F.col(text), "\n", -1), lambda x: _filled(line_key(x)))).alias("__pos", "__h")).where("__h is not null").select("__t", "__pos", F.col("__h.a").alias("a"), F.col("__h.b").alias("b"))
        drops = lines.join(side, ["a", "b"], "left_semi").groupBy("__t").agg(F.sort_array(F.collect_set("__pos")).alias("__at"))
        out = rows.join(drops, "__t", "left")
    lines, gone = F.split(F.col(text), "\n", -1), F.col("__at")
    kept = F.when(gone.isNull(), F.col(text)).otherwise(_without(lines, gone))
    return out.select(*[c for c in docs.columns if c not in (text, "n_lines", "n_dropped")], kept.alias(text), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


#: What drop_shared_lines() finds, over ``documents``, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
