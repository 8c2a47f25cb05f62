"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without it: it gets a temporary folder of its own.
    """
    place = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if place:
        return place.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="ctxweave-")
    return _LOCAL[app]


#: What this process has staged: a folder, and the name of its catalog table if it has one.
_STAGED: dict[str, str | None] = {}


def stage(df: DataFrame, label: str, by: list[str] | None = None, row_group: int = 128 << 20) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there.

    With ``by``, files lie in folders by these columns, so a filter on them reads no others. The files
    outlive the query, as its result may be read at any later time, until ``clear``, ``discard`` or the process's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ctxweave-stage/{label}-{uuid.uuid4().hex}"
    _STAGED[path] = None
    df.write.option("compression", "zstd").option("parquet.block.size", row_group).partitionBy(*by or []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged = path
    return out


def stage_by(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Like ``stage``, bucketed by ``keys``: later joins on them shuffle their other side only.

    There are as many buckets as spark.sql.shuffle.partitions.
    """
    spark = df.sparkSession
    name, n = f"ctxweave_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = f"{shared_dir(spark)}/ctxweave-stage/{name}"
    _STAGED[place] = name
    df.write.format("parquet").option("compression", "zstd").option("path", place).bucketBy(n, *keys).saveAsTable(name)
    return spark.table(name)


def discard(staged: DataFrame) -> None:
    """Remove what ``stage`` wrote for ``staged``, once nothing reads it any more."""
    _remove(staged.sparkSession, staged.staged)


def drop_shuffles(spark: SparkSession) -> None:
    """Have shuffle files removed that no plan refers to any more; Spark finds them when the driver's JVM collects garbage, which may be long after."""
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove all that this process has staged, catalog tables too; results that still read it can't be read again."""
    for path in list(_STAGED):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    if name := _STAGED.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_end() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # noqa: S110 - the JVM may have gone first
        pass
    for path in _STAGED:  # the session has ended: folders of this machine can still go, others stay for the folder's owner
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
