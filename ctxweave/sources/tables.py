"""Chunk tables and request logs from the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import build_chunks
from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation a context."""
    rows = table(spark, sf_dir, "conversations")
    return build_chunks(rows.select(F.col("conv_id").alias("ctx_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content")))


def documents(spark: SparkSession, sf_dir: str, scored: bool = False) -> DataFrame:
    """Each source's documents a context of retrieved chunks; ``scored``: with the label's quality as relevance."""
    rows = table(spark, sf_dir, "documents")
    if scored:
        rows = rows.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("relevance_score")), "doc_id", "left")
    else:
        rows = rows.withColumn("relevance_score", F.lit(None).cast("double"))
    return build_chunks(rows.select(F.expr("try_cast(substr(source, 4) AS bigint)").alias("ctx_id"), F.col("doc_id").alias("pos"), F.lit("document").alias("role"), F.col("text").alias("content"), "relevance_score"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of requests: the type is the model, the value gives the tokens."""
    tokens = F.floor(F.abs("value") * 10).cast("long")
    e = table(spark, sf_dir, "events").withColumn("original_tokens", tokens)
    return e.select(
        F.col("event_id").alias("request_id"), F.element_at(F.array(*map(F.lit, ("gpt-4o", "gpt-4.1", "unknown"))), (F.col("user_id") % 3 + 1).cast("int")).alias("model"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("bookend"), F.lit("prune"))).otherwise(F.array(F.lit("bookend"))).alias("strategies"),
        "original_tokens", F.floor(F.col("original_tokens") * F.lit(0.75)).cast("long").alias("optimized_tokens"), (F.col("event_id") % 5 != 0).alias("was_optimized"), (F.col("event_id") % 10 == 0).alias("was_fallback"), (F.col("event_id") % 3 == 0).alias("is_streaming"), (F.col("event_id") % 7).cast("long").alias("latency_ms"),
    )
