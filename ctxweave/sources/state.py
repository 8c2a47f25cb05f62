"""Fingerprints, loss reports, pending injections and the event log, as Parquet tables below one folder."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compaction import DEFAULTS

TABLES = ("fingerprints", "loss_reports", "pending_injections", "delivered_injections", "compaction_log")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local master may go without that."""
    place = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not place and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{place.rstrip('/') or 'file://' + tempfile.mkdtemp(prefix='ctxweave-')}/ctxweave-state/{uuid.uuid4().hex}"


class StateStore:
    """Tables that grow by appending; what was written last for a session is read by its version, so a reader never sees half a write."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"unknown table: {table}")
        return f"{self.folder}/{table}"

    def init(self) -> bool:
        """Write the default settings unless there are some; whether they were written."""
        if self._exists(f"{self.folder}/config"):
            return False
        self.spark.createDataFrame([(json.dumps(DEFAULTS | {"enabled": True}, indent=2),)], "value string").coalesce(1).write.text(f"{self.folder}/config")
        return True

    def settings(self) -> dict:
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/config").collect()
        return json.loads("".join(r[0] for r in rows))

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _claim(self, path: str) -> bool:
        """Whether this call made the file: file systems make one of a name once."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(p.getParent())
        try:
            fs.create(p, False).close()
        except Exception:  # it is there already
            if fs.exists(p):
                return False
            raise
        return True

    def append(self, table: str, rows: DataFrame, version: int | None = None) -> None:
        """Add ``rows``; ``version`` orders the writes of a session (now, unless given)."""
        v = F.lit(version).cast("long") if version is not None else F.unix_micros(F.current_timestamp())
        rows.withColumn("version", v).write.mode("append").parquet(self.path(table))

    def all(self, table: str) -> DataFrame | None:
        return self.spark.read.parquet(self.path(table)) if self._exists(self.path(table)) else None

    def latest(self, table: str, session_id: str | None = None) -> DataFrame | None:
        """The rows of each session's last write, or of one session's."""
        rows = self.all(table)
        if rows is None:
            return None
        if session_id is not None:
            rows = rows.where(F.col("session_id") == session_id)
        newest = rows.groupBy("session_id").agg(F.max("version").alias("version"))
        return rows.join(newest, ["session_id", "version"])

    def take_injection(self, session_id: str) -> str | None:
        """The session's pending injection, once.

        A taker claims it by making a marker file of its own name, which only one can; the others get
        nothing, also if the winner is lost before it records the delivery.
        """
        pending = self.latest("pending_injections", session_id)
        if pending is None:
            return None
        done = self.all("delivered_injections")
        if done is not None:
            pending = pending.join(done.select("session_id", F.col("delivered").alias("version")), ["session_id", "version"], "left_anti")
        row = pending.select("text", "version").first()
        if row is None:
            return None
        if not self._claim(f"{self.folder}/claims/{safe_name(session_id)}-{row[1]}"):
            return None
        self.append("delivered_injections", self.spark.createDataFrame([(session_id, row[1])], "session_id string, delivered long"))
        return row[0]

    def history(self, session_id: str | None = None) -> DataFrame | None:
        """Events in the order they were written."""
        rows = self.all("compaction_log")
        if rows is None:
            return None
        return (rows.where(F.col("session_id") == session_id) if session_id else rows).orderBy("version", "timestamp")


def safe_name(session_id: str) -> str:
    """A file name for a session, different for different ones."""
    return hashlib.sha256(session_id.encode()).hexdigest()[:32]


def history_ratios(events: DataFrame) -> DataFrame:
    """session_id, compactions, items, preserved share."""
    out = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("compactions"), F.sum("total_items").alias("items"), F.sum("preserved").alias("preserved"))
    return out.withColumn("preserved_ratio", F.when(F.col("items") > 0, F.col("preserved") / F.greatest(F.col("items"), F.lit(1))).otherwise(0.0))
