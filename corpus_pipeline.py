"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to the folder of
spark.checkpoint.dir and reads them back as the next one's documents, so a lost executor costs work of
one stage only. An extra column whose name a stage uses inside is carried through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxweave.llm import decontaminate, line_dedup, ngram_join, packing, quality
from ctxweave.llm.common import stage, table, tune
from ctxweave.llm.queries import quality_model

#: Documents scored below this go.
QUALITY = 0.3
#: Lines that so many documents share go.
LINE_DOCS = 10
#: Near copies: shingles of so many words, and the similarity from which two documents link, in percent.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network doesn't reject. It learns like op10_quality: from labelled rows outside the held-out fold (see quality.train for the bound).

    Every row is judged by its own text: equal texts alike, null as an empty text, which has a score too.
    """
    tune(spark)
    model = quality_model(spark, sf_dir)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return quality.score_quality(held, model, ["row"], QUALITY).where("predicted = 1").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that LINE_DOCS rows share; n_chars follows. A row that loses every line stays, with an empty text; null stays null. A repeated row counts as often as it stands there."""
    tune(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    held = docs.select(F.struct(*others).alias("row"), F.col("text").alias("before"), "text")
    out = line_dedup.drop_shared_lines(held, LINE_DOCS)
    kept = F.when(F.col("before").isNull(), F.lit(None)).otherwise(F.col("text"))
    return out.withColumn("text", kept).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(c) if c in ("text", "n_chars") else F.col(f"row.`{c}`") for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, and of several with this id any one.

    Every row is a document of its own, known by a key that it gets here, so rows of one doc_id are compared
    with each other like any others: a repeated row goes, a different text under the same id stays. Rows without a
    doc_id take part and yield to those with one. Rows without words (null, empty, white space) link with nothing and stay.
    """
    tune(spark)
    held = stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("id")), "rows")
    near = ngram_join.near_duplicates(held.select(F.col("id").alias("doc_id"), "row.text"), SHINGLE_WORDS, SIMILARITY).select(F.col("doc_id").alias("id"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("without"), F.col("row.doc_id").alias("doc_id"), "id")
    members = near.join(held.select("id", order.alias("order")), "id")
    first = members.groupBy("component_id").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("first.id").alias("kept"))
    gone = members.join(first, "component_id").where("id <> kept").select("id")
    return held.join(gone, "id", "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, not even slightly changed. Each is judged by its own text alone, whatever its doc_id; rows with a null or empty text stay."""
    tune(spark)
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 ids (see packing.pack_documents), with each piece's ids.

    Every row is packed, a repeated one as often as it stands there and one without a doc_id under null; a
    null or empty text is one piece with the end id alone. Columns other than doc_id and text don't go on.
    """
    tune(spark)
    return packing.pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: No SQL expresses the network, the approximate matches or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
