"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..staging import clear, discard, shared_dir, stage, stage_by  # noqa: F401

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds of its input at once.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def tune(spark: SparkSession) -> None:
    """The package on the workers, and small Arrow batches, so that very long texts do not pile up there."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (of files: their size), 4 GB where it knows none; no job runs."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 55 else 4 << 30


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; CTXWEAVE_TOKENIZERS overrides the folder."""
    folder = os.environ.get("CTXWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def batches(rows: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One batch of ``rows``, if there are any."""
    if rows and len(next(iter(rows.values()))):
        yield pa.RecordBatch.from_pydict(rows, schema=schema)
