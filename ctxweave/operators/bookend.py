"""Reordering by relevance: the best chunks at both ends, the least in the middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_words
from .chunks import per_context, is_conversation, last_users, size_of_context


def heuristic_score() -> Column:
    """For conversations: system 1, the last three users 0.9, a single chunk 0.5, else rising to 0.7; others keep their score."""
    n = size_of_context()
    score = F.when(F.col("role") == "system", 1.0).when(last_users(3), 0.9).when(n <= 1, 0.5).otherwise(0.1 + 0.6 * (F.col("pos") / F.greatest(n - 1, F.lit(1))))
    return F.when(is_conversation(), score).otherwise(F.col("relevance_score"))


def score_by_query(chunks: DataFrame, query: str) -> DataFrame:
    """``relevance_score`` by TF-IDF of the query's words, repeats counting, as a share of the context's best; system rows 1.

    A query without words leaves the heuristic score.
    """
    spark = chunks.sparkSession
    asked = spark.range(1).select(query_words(F.lit(query)).alias("w")).first()[0]
    if not asked:
        return chunks.withColumn("relevance_score", heuristic_score())
    terms = sorted(set(asked))
    out = chunks.withColumn("__w", query_words("content")).withColumn("__n", size_of_context())
    score = F.lit(0.0)
    for i, t in enumerate(terms):  # one column for each word of the query; nothing is exploded or joined
        out = out.withColumn(f"__tf{i}", F.size("__w") - F.size(F.array_remove("__w", t)))
        df = F.sum((F.col(f"__tf{i}") > 0).cast("int")).over(per_context())
        idf = F.greatest(F.ln(F.col("__n") / (1 + df)), F.lit(0.0))
        score = score + F.when(F.size("__w") > 0, F.col(f"__tf{i}") / F.greatest(F.size("__w"), F.lit(1))).otherwise(0.0) * idf * asked.count(t)
    out = out.withColumn("__score", score)
    best = F.max("__score").over(per_context())
    share = F.when(best > 0, F.col("__score") / F.when(best > 0, best)).otherwise(F.col("__score"))
    return out.withColumn("relevance_score", F.when(F.col("role") == "system", 1.0).otherwise(share)).select(*chunks.columns)


def place(chunks: DataFrame) -> DataFrame:
    """Ranks 0, 2, 4 ... by relevance go to the front, ranks 1, 3, 5 ... to the back; ties by position."""
    r = F.row_number().over(per_context().orderBy(F.col("relevance_score").desc(), "pos")) - 1
    n = size_of_context()
    out = chunks.withColumns({"__r": r, "__n": n})
    return out.withColumn("pos", F.when(F.col("__r") % 2 == 0, F.floor(F.col("__r") / 2)).otherwise(F.col("__n") - 1 - F.floor((F.col("__r") - 1) / 2)).cast("long")).drop("__r", "__n")


def bookend(chunks: DataFrame, query: str | None = None) -> DataFrame:
    scored = score_by_query(chunks, query) if query else chunks.withColumn("relevance_score", heuristic_score())
    return place(scored)
