"""What a summary of a session lost, and what to bring back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import section_words
from ..functions.tokens import TokenCounter, bytes4

# Thresholds and limits.
DEFAULTS = {"injection_budget_tokens": 4096, "min_priority_score": 0.1, "max_items": 200, "preserved_threshold": 0.7, "lost_threshold": 0.3, "recency_decay_rate": 0.05}

# What marks an item of each kind; the first kind that fits counts.
PATTERNS = {
    "Constraint": r"(?i)\b(must|should not|requirement|constraint|limit|budget|deadline)\b",
    "Decision": r"(?i)\b(chose|decided|went with|because|trade-off|instead of)\b",
    "DebugInsight": r"(?i)(the issue was|root cause|fixed by|error was caused by)",
    "ProgressMarker": r"(?i)\b(done|completed|remaining|todo|next step)\b",
    "TechnicalFact": r"(https?://\S+|\b\d{1,3}(\.\d{1,3}){3}\b|\bport \d+|(^|\s)/[\w./-]+|\bv?\d+\.\d+\.\d+\b)",
}
LABELS = {"Constraint": "CONSTRAINT", "Decision": "DECISION", "TechnicalFact": "TECHNICAL", "DebugInsight": "DEBUG", "ProgressMarker": "PROGRESS", "Other": "OTHER"}


def category(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def extract_items(chunks: DataFrame, counter: TokenCounter = bytes4, decay: float = DEFAULTS["recency_decay_rate"]) -> DataFrame:
    """Items of each context: sentences of a known kind, alike ones merged, with their scores.

    uniqueness = 1 / occurrences, recency = e^(-decay * messages since the last), position_risk = how deep in
    the middle the first stands (0 at the ends, 1 in the centre of the tokens); priority is their product.
    """
    w = Window.partitionBy("ctx_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("token_count").over(Window.partitionBy("ctx_id"))
    start = F.coalesce(F.sum("token_count").over(w), F.lit(0))
    rows = chunks.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("ctx_id")), "share": F.when(total > 0, start / F.greatest(total, F.lit(1))).otherwise(0.0)})
    pieces = rows.select("ctx_id", "pos", "n", "share", F.explode(F.split("content", r"\n|(?<=[.!?])\s+")).alias("content"))
    pieces = pieces.withColumn("content", F.trim("content")).withColumn("category", category(F.col("content"))).where("category IS NOT NULL AND content <> ''")
    items = pieces.groupBy("ctx_id", F.lower("content").alias("key")).agg(F.min_by("content", "pos").alias("content"), F.min_by("category", "pos").alias("category"), F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_set("pos")).alias("source_positions"), F.max("pos").alias("last"), F.max("n").alias("n"), F.min_by("share", "pos").alias("share"))
    items = items.withColumns({"tokens": counter(F.col("content")), "item_id": F.substring(F.sha2("key", 256), 1, 16), "uniqueness": 1.0 / F.col("occurrence_count"), "recency": F.exp(-decay * (F.col("n") - 1 - F.col("last"))), "position_risk": 1 - F.abs(F.col("share") - 0.5) * 2})
    items = items.withColumn("priority_score", F.col("uniqueness") * F.col("recency") * F.col("position_risk"))
    return items.select("ctx_id", "item_id", "category", "content", "tokens", "occurrence_count", "source_positions", "uniqueness", "recency", "position_risk", "priority_score")


def keep_best(items: DataFrame, least: float = DEFAULTS["min_priority_score"], most: int = DEFAULTS["max_items"]) -> DataFrame:
    """The items that a fingerprint holds: by priority, at least ``least``, at most ``most`` for each context."""
    w = Window.partitionBy("ctx_id").orderBy(F.col("priority_score").desc(), "item_id")
    return items.where(F.col("priority_score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def loss_classify(items: DataFrame, summaries: DataFrame, preserved: float = DEFAULTS["preserved_threshold"], lost: float = DEFAULTS["lost_threshold"]) -> DataFrame:
    """``items`` with overlap_score, the share of their words that the context's summary (ctx_id, summary) holds, and what that means."""
    said = summaries.select("ctx_id", section_words("summary").alias("__said"))
    own = section_words("content")
    rows = items.join(said, "ctx_id", "left").withColumn("__own", own)
    shared = F.size(F.array_intersect("__own", F.coalesce("__said", F.array().cast("array<string>"))))
    rows = rows.withColumn("overlap_score", F.when(F.size("__own") > 0, shared / F.greatest(F.size("__own"), F.lit(1))).otherwise(0.0))
    state = F.when(F.col("overlap_score") >= preserved, "preserved").when(F.col("overlap_score") >= lost, "paraphrased").otherwise("lost")
    return rows.withColumn("state", state).drop("__said", "__own")


def loss_report(classified: DataFrame) -> DataFrame:
    """ctx_id, total_fingerprinted, the counts of each state, preservation_ratio."""
    out = classified.groupBy("ctx_id").agg(F.count(F.lit(1)).alias("total_fingerprinted"), *[F.count_if(F.col("state") == s).alias(f"{s}_count") for s in ("preserved", "paraphrased", "lost")])
    return out.withColumn("preservation_ratio", F.col("preserved_count") / F.col("total_fingerprinted"))


def injection_select(lost: DataFrame, budget: int = DEFAULTS["injection_budget_tokens"]) -> DataFrame:
    """Lost items by priority as long as their tokens fit ``budget`` together; if the first alone doesn't, it is cut to fit.

    Adds ``rank``; a cut item has ``truncated``. An item that doesn't fit ends the selection.
    """
    order = Window.partitionBy("ctx_id").orderBy(F.col("priority_score").desc(), "item_id")
    rows = lost.withColumns({"rank": F.row_number().over(order), "__sum": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    first = (F.col("rank") == 1) & (F.col("tokens") > budget)
    out = rows.where((F.col("__sum") <= budget) | first).withColumn("truncated", first)
    return out.withColumns({"content": F.when(first, F.substring("content", 1, 4 * budget)).otherwise(F.col("content")), "tokens": F.when(first, F.lit(budget).cast("long")).otherwise(F.col("tokens"))}).drop("__sum")


def injection_text(selected: DataFrame) -> DataFrame:
    """ctx_id, text: the selected items as lines with their kind and where they stood."""
    label = F.lit("OTHER")
    for name, shown in LABELS.items():
        label = F.when(F.col("category") == name, shown).otherwise(label)
    a, b = F.array_min("source_positions"), F.array_max("source_positions")
    where = F.when(a == b, F.concat(F.lit("message "), a)).otherwise(F.concat(F.lit("messages "), a, F.lit("-"), b))
    line = F.concat(label, F.lit(": "), "content", F.lit("\n(Originally stated in "), where, F.lit(", not found in compaction summary)"))
    rows = selected.select("ctx_id", "rank", "tokens", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    head = F.concat(F.lit("Context items recovered from pre-compaction analysis ("), F.count(F.lit(1)), F.lit(" items, "), F.sum("tokens"), F.lit(" tokens):\n\n"))
    return rows.groupBy("ctx_id").agg(F.concat(head, F.array_join(lines, "\n\n")).alias("text"))
