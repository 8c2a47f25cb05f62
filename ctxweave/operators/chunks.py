"""Building chunk tables, and what holds for every chunk: order, default relevance, attention zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.tokens import TokenCounter, bytes4
from ..schema import COLUMNS, require


def per_context() -> WindowSpec:
    return Window.partitionBy("ctx_id")


def before() -> WindowSpec:
    """All rows before this one in its context."""
    return per_context().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def size_of_context() -> Column:
    return F.count(F.lit(1)).over(per_context())


def default_relevance(role: Column, pos: Column, n: Column) -> Column:
    """1 for system, 0.5 for a single chunk, else rising from 0.1 to 0.9 along the context."""
    return F.when(role == "system", 1.0).when(n <= 1, 0.5).otherwise(0.1 + 0.8 * (pos / F.greatest(n - 1, F.lit(1))))


def with_zones(chunks: DataFrame) -> DataFrame:
    """``attention_zone``: dead_zone for a chunk that starts in the second or third quarter of its context's tokens."""
    total, start = F.sum("token_count").over(per_context()), F.coalesce(F.sum("token_count").over(before()), F.lit(0))
    share = start / F.when(total > 0, total)
    return chunks.withColumn("attention_zone", F.when((share >= 0.25) & (share < 0.75), "dead_zone").otherwise("strong"))


def with_dense_positions(chunks: DataFrame, *order: Column | str) -> DataFrame:
    """``pos`` anew, dense from 0 in the order given."""
    return chunks.withColumn("pos", (F.row_number().over(per_context().orderBy(*order)) - 1).cast("long"))


def build_chunks(messages: DataFrame, counter: TokenCounter = bytes4) -> DataFrame:
    """The chunk table of ``messages`` (ctx_id, pos, role, content and perhaps relevance_score).

    Relevance is clamped to [0, 1]; null or absent it is the default of role and position. Null
    content is empty. Positions are made dense; ties in pos fall by content.
    """
    require(messages, ["ctx_id", "pos", "role", "content"])
    rows = messages.select(F.col("ctx_id").cast("long"), F.col("pos").cast("long"), "role", F.coalesce("content", F.lit("")).alias("content"), (F.col("relevance_score") if "relevance_score" in messages.columns else F.lit(None)).cast("double").alias("given"))
    rows = with_dense_positions(rows, "pos", "content", "role").withColumns({"chunk_index": F.col("pos"), "token_count": counter(F.col("content"))})
    given = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("given")))
    rows = rows.withColumn("relevance_score", F.when(F.col("given").isNull(), default_relevance(F.col("role"), F.col("pos"), size_of_context())).otherwise(given))
    return with_zones(rows).select(*COLUMNS)


def is_small(df: DataFrame, most: int = 16 << 20) -> bool:
    """Whether all that ``df`` reads is so little, by Catalyst's estimate of its sources, that any context fits one group; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) <= most


def recount(chunks: DataFrame, counter: TokenCounter = bytes4) -> DataFrame:
    return chunks.withColumn("token_count", counter(F.col("content")))


def last_users(k: int) -> Column:
    """Whether a row is one of the last ``k`` user rows of its context, in the current order."""
    back = F.row_number().over(Window.partitionBy("ctx_id", "role").orderBy(F.col("pos").desc()))
    return (F.col("role") == "user") & (back <= k)


def is_protected() -> Column:
    """System rows and the last two user rows."""
    return (F.col("role") == "system") | last_users(2)


def is_conversation() -> Column:
    """Whether a context holds no role but system, user and assistant."""
    return F.min(F.col("role").isin("system", "user", "assistant")).over(per_context())


def dead_zone_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("attention_zone") == "dead_zone")


def to_messages(chunks: DataFrame) -> DataFrame:
    """One row for each context: its messages in order, as an array and as JSON."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return chunks.groupBy("ctx_id").agg(messages.alias("messages")).withColumn("json", F.to_json("messages"))


def count_tokens(chunks: DataFrame) -> DataFrame:
    """ctx_id, n_chunks, total_tokens."""
    return chunks.groupBy("ctx_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("total_tokens"))
