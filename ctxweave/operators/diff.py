"""What changed between two versions of a context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .health import analyze

PREFIX = 80


def exact_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """ctx_id, pos_before, pos_after, role: the k-th row of a content meets the k-th row of the same content."""
    nth = F.row_number().over(Window.partitionBy("ctx_id", "content").orderBy("pos"))
    a, b = before.withColumn("k", nth), after.withColumn("k", nth)
    on = ["ctx_id", "content", "k"]
    return a.select(*on, F.col("pos").alias("pos_before"), "role").join(b.select(*on, F.col("pos").alias("pos_after")), on).select("ctx_id", "pos_before", "pos_after", "role")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    return exact_matches(before, after).where("pos_before <> pos_after")


def compressed_and_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """ctx_id, pos_before, role, before_tokens, after_tokens (null: removed) of the rows without an exact match.

    In order, each takes the first free row of its role where one's first 80 characters begin the other.
    """
    hit = exact_matches(before, after)
    left = before.join(hit.select("ctx_id", F.col("pos_before").alias("pos")), ["ctx_id", "pos"], "left_anti").select("ctx_id", "pos", "role", "content", "token_count", F.lit(0).alias("side"))
    free = after.join(hit.select("ctx_id", F.col("pos_after").alias("pos")), ["ctx_id", "pos"], "left_anti").select("ctx_id", "pos", "role", "content", "token_count", F.lit(1).alias("side"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        old, new = (pdf[pdf.side == s].sort_values("pos").to_dict("records") for s in (0, 1))
        out = []
        for b in old:
            fits = (k for k, a in enumerate(new) if a["role"] == b["role"] and (a["content"].startswith(b["content"][:PREFIX]) or b["content"].startswith(a["content"][:PREFIX])))
            k = next(fits, None)
            out.append((b["ctx_id"], b["pos"], b["role"], b["token_count"], None if k is None else new.pop(k)["token_count"]))
        return pd.DataFrame(out, columns=["ctx_id", "pos_before", "role", "before_tokens", "after_tokens"]).astype({"after_tokens": "Int64"})

    return left.unionByName(free).groupBy("ctx_id").applyInPandas(match, "ctx_id long, pos_before long, role string, before_tokens long, after_tokens long")


def diff_summary(before: DataFrame, after: DataFrame, model: str = "default") -> DataFrame:
    """One row for each context: tokens, messages, dead zone, duplicates and health on both sides, and the changes."""
    columns = {"total_tokens": "tokens", "n_chunks": "messages", "dead_zone_tokens": "dead_zone_tokens", "duplicate_tokens": "duplicate_tokens", "health_score": "health_score"}
    sides = [analyze(df, model).select("ctx_id", *[F.col(c).alias(f"{side}_{n}") for c, n in columns.items()]) for side, df in (("before", before), ("after", after))]
    out = sides[0].join(sides[1], "ctx_id", "full")
    zero = F.lit(0).cast("long")
    out = out.select("ctx_id", *[F.coalesce(c, zero).alias(c) for c in out.columns if c != "ctx_id"])
    change = F.when(F.col("before_tokens") > 0, (F.col("after_tokens") - F.col("before_tokens")) / F.greatest(F.col("before_tokens"), F.lit(1)) * 100).otherwise(0.0)
    return out.withColumns({"token_change_pct": change, "health_score_delta": F.col("after_health_score") - F.col("before_health_score")})


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """ctx_id, before_tokens, after_tokens, saved, reduction_pct."""
    total = lambda df, name: df.groupBy("ctx_id").agg(F.sum("token_count").alias(name))
    out = total(before, "before_tokens").join(total(after, "after_tokens"), "ctx_id", "left").withColumn("after_tokens", F.coalesce("after_tokens", F.lit(0).cast("long")))
    saved = F.greatest(F.col("before_tokens") - F.col("after_tokens"), F.lit(0).cast("long"))
    return out.withColumns({"saved": saved, "reduction_pct": F.when(F.col("before_tokens") > 0, saved / F.greatest(F.col("before_tokens"), F.lit(1)) * 100).otherwise(0.0)})
