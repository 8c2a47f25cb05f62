"""The queries opN_<name> over the synthetic tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, decontaminate, language_id, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, token_counts
from .common import table, tune


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(rows, F.col("doc_id"), 40, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), doc="doc_id")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cover_tree.quantized("embedding").alias("v"))
    return cover_tree.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(4) != 2)
    return language_id.identify(docs.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False))), model)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.ByteCnn:
    """The network, from the labelled documents outside the held-out fold."""
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    model = quality_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    return quality.score_quality(docs, model, ["doc_id", "held_out"], 0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_sharding, op3_token_counts, op4_line_dedup, op5_cover_tree, op6_suffix_dedup, op7_ngram_join, op8_decontamination, op9_language_id, op10_quality)}
SQL: dict[str, str] = {"op4_line_dedup": line_dedup.SQL, "op5_cover_tree": cover_tree.SQL}
