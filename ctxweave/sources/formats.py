"""Reading chat messages from JSON texts of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("openai", "anthropic", "rag_chunks", "raw")
_MESSAGES = "array<struct<role:string,content:string,relevance_score:double>>"


def _kind(v: str) -> str:
    """SQL: the kind of the variant ``v``, null where there is none."""
    return f"schema_of_variant({v})"


def _has(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$.{key}', 'variant') IS NOT NULL"


def _text(v: str, key: str) -> str:
    """SQL: a string field; null where there is none or another kind."""
    return f"CASE WHEN {_kind(f'try_variant_get({v}, {chr(39)}$.{key}{chr(39)}, {chr(39)}variant{chr(39)})')} = 'STRING' THEN try_variant_get({v}, '$.{key}', 'string') END"


def _format(v: str, items: str) -> str:
    """SQL: the format of the parsed text ``v`` with the array elements ``items``."""
    typed = f"exists(try_variant_get(m, '$.content', 'array<variant>'), b -> {_has('b', 'type')})"
    return f"""CASE WHEN coalesce({_kind(v)} LIKE 'ARRAY%', false) THEN CASE
        WHEN size({items}) = 0 THEN 'openai'
        WHEN {_has(f'{items}[0]', 'role')} THEN CASE WHEN exists({items}, m -> coalesce({typed}, false)) THEN 'anthropic' ELSE 'openai' END
        WHEN {_has(f'{items}[0]', 'content')} THEN 'rag_chunks' ELSE 'raw' END ELSE 'raw' END"""


def detect_format(raw: Column | str) -> Column:
    """openai, anthropic, rag_chunks or raw, by the shape of a JSON array; anything else is raw."""
    c = raw if isinstance(raw, str) else "raw"
    parsed = f"try_parse_json(trim({c}))"
    one = f"transform(array({parsed}), v -> transform(array(try_variant_get(v, '$', 'array<variant>')), x -> {_format('v', 'x')})[0])[0]"
    return F.expr(one)


def parse_messages(raw: DataFrame, input_format: str | None = None, failfast: bool = False) -> DataFrame:
    """ctx_id, pos, role, content, relevance_score of the messages in ``raw`` (ctx_id, raw).

    ``input_format`` overrides what is detected. A text with an element that doesn't fit its format gives
    one row with null pos and an ``error``, or with ``failfast`` fails the query. A text is parsed once: each step below is a
    column that later ones use several times, and errors leave through the same explosion as messages do.
    """
    if input_format is not None and input_format not in FORMATS:
        raise ValueError(f"unknown input format: {input_format}")
    blocks = f"array_join(transform(filter(try_variant_get(m, '$.content', 'array<variant>'), b -> ({_text('b', 'type')}) = 'text' AND ({_text('b', 'text')}) IS NOT NULL), b -> {_text('b', 'text')}), '\n\n')"
    parsed = f"""CASE fmt
        WHEN 'openai' THEN transform(items, m -> named_struct('role', {_text('m', 'role')}, 'content', {_text('m', 'content')}, 'relevance_score', try_variant_get(m, '$.relevance_score', 'double')))
        WHEN 'anthropic' THEN transform(items, m -> named_struct('role', {_text('m', 'role')}, 'content', CASE WHEN try_variant_get(m, '$.content', 'array<variant>') IS NOT NULL THEN {blocks} ELSE {_text('m', 'content')} END, 'relevance_score', CAST(NULL AS DOUBLE)))
        WHEN 'rag_chunks' THEN transform(items, m -> named_struct('role', 'document', 'content', {_text('m', 'content')}, 'relevance_score', try_variant_get(m, '$.score', 'double')))
        ELSE array(named_struct('role', 'document', 'content', raw, 'relevance_score', CAST(NULL AS DOUBLE))) END"""
    rows = raw.select("ctx_id", "raw").withColumn("v", F.expr("try_parse_json(trim(raw))")).withColumn("items", F.expr("try_variant_get(v, '$', 'array<variant>')"))
    rows = rows.withColumn("fmt", F.lit(input_format) if input_format else F.expr(_format("v", "items"))).withColumn("messages", F.expr(parsed).cast(_MESSAGES))
    bad = F.col("messages").isNull() | F.exists("messages", lambda m: m["role"].isNull() | m["content"].isNull())
    said = F.concat(F.lit("not valid as "), "fmt")
    none = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("double").alias("relevance_score"), (F.raise_error(said).cast("string") if failfast else said).alias("error"))
    good = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["relevance_score"].alias("relevance_score"), F.lit(None).cast("string").alias("error")))
    out = rows.select("ctx_id", F.posexplode(F.when(bad, F.array(none)).otherwise(good)).alias("pos", "m"))
    return out.select("ctx_id", F.when(F.col("m.error").isNull(), F.col("pos")).cast("long").alias("pos"), "m.role", "m.content", "m.relevance_score", "m.error")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """ctx_id, path, raw of each file below ``path``, whole; a file that isn't UTF-8 has a null raw and an ``error``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.expr("try_validate_utf8(cast(content as string))")
    return files.select(F.xxhash64("path").alias("ctx_id"), "path", text.alias("raw")).withColumn("error", F.when(F.col("raw").isNull(), F.lit("not UTF-8")))
