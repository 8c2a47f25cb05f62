"""The chunk table and the other row types that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: One row for each chunk of a context. pos is the current position, dense from 0 in each context;
#: chunk_index is the position at the start and never changes.
CHUNK = T.StructType([T.StructField("ctx_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("chunk_index", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("token_count", T.LongType()), T.StructField("relevance_score", T.DoubleType()), T.StructField("attention_zone", T.StringType())])
COLUMNS = CHUNK.names

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("relevance_score", T.DoubleType())])
RAG_CHUNK = T.StructType([T.StructField("content", T.StringType()), T.StructField("score", T.DoubleType())])

REQUEST_LOG = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("model", T.StringType()), T.StructField("strategies", T.ArrayType(T.StringType())), T.StructField("original_tokens", T.LongType()), T.StructField("optimized_tokens", T.LongType()), T.StructField("was_optimized", T.BooleanType()), T.StructField("was_fallback", T.BooleanType()), T.StructField("is_streaming", T.BooleanType()), T.StructField("latency_ms", T.LongType())])

ITEM = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("content", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("occurrence_count", T.LongType()), T.StructField("source_positions", T.ArrayType(T.LongType())), T.StructField("uniqueness", T.DoubleType()), T.StructField("recency", T.DoubleType()), T.StructField("position_risk", T.DoubleType()), T.StructField("priority_score", T.DoubleType())])

EVENT = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("trigger", T.StringType()), T.StructField("total_items", T.LongType()), T.StructField("preserved", T.LongType()), T.StructField("paraphrased", T.LongType()), T.StructField("lost", T.LongType()), T.StructField("injection_tokens", T.LongType())])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, if it has all ``columns``."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
