"""The health report of each context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import model_budget
from ..functions.text import grade, with_commas
from .duplication import pairs_and_chunks

#: Weights of the three scores.
WEIGHTS = {"dead_zone_score": 0.30 / 0.75, "duplication_score": 0.25 / 0.75, "budget_score": 0.20 / 0.75}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.greatest(whole, F.lit(1))).otherwise(0.0)


def _score(ratio: Column) -> Column:
    return F.round((1 - ratio) * 100).cast("long")


def dead_zone_metric(chunks: DataFrame) -> DataFrame:
    """ctx_id, total_tokens, n_chunks and tokens, chunks, ratio and score of the dead zone."""
    dead = F.col("attention_zone") == "dead_zone"
    out = chunks.groupBy("ctx_id").agg(F.sum("token_count").alias("total_tokens"), F.count(F.lit(1)).alias("n_chunks"), F.sum(F.when(dead, F.col("token_count")).otherwise(0)).alias("dead_zone_tokens"), F.count_if(dead).alias("dead_zone_chunks"))
    out = out.withColumn("dead_zone_ratio", _ratio(F.col("dead_zone_tokens"), F.col("total_tokens")))
    return out.withColumn("dead_zone_score", _score(F.col("dead_zone_ratio")))


def budget_metric(totals: DataFrame, budget: int) -> DataFrame:
    """Adds budget, utilization and budget_score (0 above the budget) to a table with total_tokens."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    out = totals.withColumns({"budget": F.lit(budget).cast("long"), "utilization": F.col("total_tokens") / F.lit(float(budget))})
    return out.withColumn("budget_score", F.when(F.col("utilization") > 1, F.lit(0).cast("long")).otherwise(_score(F.col("utilization"))))


def recommendations(budget: int) -> Column:
    """What to do about each score that is low."""
    return F.array_compact(F.array(
        F.when(F.col("dead_zone_score") < 80, F.lit("Run `optimize --strategy bookend` to fix dead zone placement")),
        F.when((F.col("duplication_score") < 90) & (F.col("duplicate_tokens") > 0), F.concat(F.lit("Run `optimize --strategy dedup` to remove ~"), with_commas("duplicate_tokens"), F.lit(" duplicate tokens"))),
        F.when(F.col("budget_score") < 20, F.lit(f"Context is near capacity — consider `compress --budget={budget // 2000}k`")),
    ))


def analyze(chunks: DataFrame, model: str = "gpt-4o", threshold: float = 0.15) -> DataFrame:
    """One row for each context: dead zone, duplication, budget, the health score 0 to 100 and recommendations."""
    budget = model_budget(model)
    pairs, chunks = pairs_and_chunks(chunks, threshold)
    dup = pairs.groupBy("ctx_id").agg(F.count(F.lit(1)).alias("duplicate_pairs"), F.round(F.sum("duplicate_tokens")).cast("long").alias("duplicate_tokens"))
    out = budget_metric(dead_zone_metric(chunks), budget).join(dup, "ctx_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("duplicate_pairs", "duplicate_tokens")})
    out = out.withColumn("duplicate_ratio", F.least(F.lit(1.0), _ratio(F.col("duplicate_tokens"), F.col("total_tokens"))))
    out = out.withColumn("duplication_score", _score(F.col("duplicate_ratio")))
    total = sum(F.col(c) * w for c, w in WEIGHTS.items())
    out = out.withColumn("health_score", F.round(total).cast("long"))
    return out.withColumns({"status": grade("health_score"), "recommendations": recommendations(budget)})


def to_json(report: DataFrame) -> DataFrame:
    """ctx_id and the report as nested JSON."""
    nested = F.struct(
        "total_tokens", F.col("n_chunks").alias("chunk_count"),
        F.struct(F.col("dead_zone_tokens").alias("tokens"), F.col("dead_zone_chunks").alias("chunks"), F.col("dead_zone_ratio").alias("ratio"), F.col("dead_zone_score").alias("score")).alias("dead_zone"),
        F.struct("duplicate_tokens", F.col("duplicate_pairs").alias("pairs"), F.col("duplicate_ratio").alias("ratio"), F.col("duplication_score").alias("score")).alias("duplication"),
        F.struct("budget", "utilization", F.col("budget_score").alias("score")).alias("budget"),
        "health_score", "recommendations",
    )
    return report.select("ctx_id", F.to_json(nested, {"pretty": "true"}).alias("json"))
