"""Figures over a log of optimized requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import price_of


def _saved() -> Column:
    return F.greatest(F.col("original_tokens") - F.col("optimized_tokens"), F.lit(0).cast("long"))


def model_metrics(log: DataFrame) -> DataFrame:
    """model, requests, tokens_saved, saved_usd over the requests that had tokens."""
    out = log.where("original_tokens > 0").groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum(_saved()).alias("tokens_saved"))
    return out.withColumn("saved_usd", F.round(F.col("tokens_saved") * price_of(F.col("model")) / 1e6, 2))


def strategy_counts(log: DataFrame) -> DataFrame:
    """strategy, n over the requests that were optimized."""
    return log.where("was_optimized").select(F.explode("strategies").alias("strategy")).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def outcome() -> Column:
    return F.when(F.col("was_fallback"), "failed").when(F.col("was_optimized"), "optimized").otherwise("passthrough")


def request_totals(log: DataFrame) -> DataFrame:
    """One row: requests by outcome, tokens, compression ratio, cost saved and the mean latency of requests that took any time."""
    kind, has = outcome(), F.col("original_tokens") > 0
    zero = F.lit(0).cast("long")
    out = log.withColumn("__price", price_of(F.col("model"))).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind == "optimized").alias("optimized"), F.count_if(kind == "passthrough").alias("passthrough"), F.count_if(kind == "failed").alias("failed"), F.count_if(F.col("is_streaming")).alias("streaming"),
        F.coalesce(F.sum(F.when(has, F.col("original_tokens"))), zero).alias("input_original"), F.coalesce(F.sum(F.when(has, F.col("optimized_tokens"))), zero).alias("input_optimized"),
        F.coalesce(F.round(F.sum(F.when(has, _saved() * F.col("__price") / 1e6)), 2), F.lit(0.0)).alias("estimated_saved_usd"),
        F.coalesce(F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), 1), F.lit(0.0)).alias("avg_optimize_latency_ms"),
    )
    out = out.withColumn("saved", F.greatest(F.col("input_original") - F.col("input_optimized"), zero))
    return out.withColumn("compression_ratio", F.when(F.col("input_original") > 0, F.round(F.col("input_optimized") / F.greatest(F.col("input_original"), F.lit(1)), 3)).otherwise(1.0))


def last_request(log: DataFrame) -> DataFrame:
    """The latest request: model, tokens before and after, latency."""
    return log.agg(F.max_by(F.struct("model", "original_tokens", "optimized_tokens", "latency_ms"), "request_id").alias("r")).select("r.*")


def after_reset(log: DataFrame, resets: DataFrame) -> DataFrame:
    """The requests since the last reset: those with a greater request_id than any of ``resets``; all of them without one."""
    last = resets.agg(F.max("request_id").alias("__reset"))
    return log.join(F.broadcast(last), F.col("__reset").isNull() | (F.col("request_id") > F.col("__reset"))).drop("__reset")


def snapshot(log: DataFrame) -> DataFrame:
    """One row with all figures, models and strategies as maps."""
    models = model_metrics(log).agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("requests", "tokens_saved", "saved_usd")))).alias("by_model"))
    strategies = strategy_counts(log).agg(F.map_from_entries(F.collect_list(F.struct("strategy", "n"))).alias("strategies"))
    last = last_request(log).select(F.struct("*").alias("last_request"))
    out = request_totals(log)
    for one in (models, strategies, last):  # one row each
        out = out.join(F.broadcast(one), F.lit(True))
    return out
