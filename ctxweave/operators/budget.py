"""Enforcing a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import before, per_context, is_protected, with_dense_positions


def marked(chunks: DataFrame, budget: int) -> DataFrame:
    """``dropped``: whether a chunk goes so that its context meets the budget.

    Unprotected chunks go from the front as long as what is left is above the budget.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    out = chunks.withColumn("__protected", is_protected())
    gone = F.coalesce(F.sum(F.when(F.col("__protected"), 0).otherwise(F.col("token_count"))).over(before()), F.lit(0))
    total = F.sum("token_count").over(per_context())
    return out.withColumns({"__total": total, "__gone": gone}).withColumn("dropped", ~F.col("__protected") & (F.col("__total") - F.col("__gone") > budget))


def truncate_to_budget(chunks: DataFrame, budget: int) -> DataFrame:
    return with_dense_positions(marked(chunks, budget).where(~F.col("dropped")).select(*chunks.columns), "pos")


def budget_warnings(chunks: DataFrame, budget: int) -> DataFrame:
    """ctx_id, seq, warning: one for each dropped chunk, and one where the protected chunks alone exceed the budget."""
    rows = marked(chunks, budget)
    text = F.concat(F.lit("Dropped chunk "), "chunk_index", F.lit(" ("), "role", F.lit(", "), "token_count", F.lit(" tokens)"))
    drops = rows.where("dropped").select("ctx_id", F.col("pos").alias("seq"), text.alias("warning"))
    left = rows.groupBy("ctx_id").agg(F.sum(F.when(F.col("dropped"), 0).otherwise(F.col("token_count"))).alias("left"), F.count(F.lit(1)).alias("seq"))
    over = left.where(F.col("left") > budget).select("ctx_id", "seq", F.concat(F.lit("Warning: protected chunks alone use "), "left", F.lit(f" tokens (budget {budget})")).alias("warning"))
    return drops.unionByName(over)


