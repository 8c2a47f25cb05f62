"""Streaming jobs: contexts that are dropped into a folder, chat requests, and running metrics."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import TokenCounter, bytes4
from ..operators.chunks import build_chunks
from ..operators.health import analyze
from ..plans.commands import load
from ..plans.pipeline import PipelineConfig, optimize, resolve
from ..schema import REQUEST_LOG

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], None]

RAW_SCHEMA = "ctx_id long, version long, raw string"


def validate_watch(source: str, auto_optimize: bool, output: str | None, spark: SparkSession | None = None) -> None:
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(source)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise ValueError(f"no such folder: {source}")
    if auto_optimize != (output is not None):
        raise ValueError("auto_optimize and output go together")
    if output is not None and output.rstrip("/") == source.rstrip("/"):
        raise ValueError("output must not be the watched folder")


def watch(spark: SparkSession, source: str, report: Sink, checkpoint: str, alert: Sink | None = None, alert_below: int = 50, auto_optimize: bool = False, output: str | None = None, strategies: list[str] | None = None, preset: str | None = None, budget: int | None = None, config: PipelineConfig = PipelineConfig(), interval: str | None = "5 seconds", errors: Sink | None = None) -> StreamingQuery:
    """Analyze each version of a context that appears below ``source`` (Parquet of ctx_id, version, raw).

    Writers add a file for each new version; a batch analyzes the newest version of each context in it.
    ``alert`` gets the contexts whose health is below ``alert_below``. With ``auto_optimize`` the optimized
    messages go to ``output``. A batch that fails is logged and the job goes on; its contexts
    are then taken one by one, and ``errors`` gets those that fail alone (ctx_id, raw). Without ``interval`` the job
    ends when it has read all there is.
    """
    validate_watch(source, auto_optimize, output, spark)
    names = resolve(strategies, preset)

    def handle(newest: DataFrame, epoch: int) -> None:
        chunks = load(newest).persist()
        found = analyze(chunks, "default").persist()
        try:
            found.count()
            new = optimize(chunks, names, budget=budget, config=config).persist() if output is not None else None
            if new is not None:
                new.count()  # what can't be computed fails before anything is reported
            report(found, epoch)
            if alert is not None:
                alert(found.where(F.col("health_score") < alert_below), epoch)
            if new is not None:
                new.write.mode("append").parquet(output)
                new.unpersist()
        finally:
            found.unpersist()
            chunks.unpersist()

    def batch(rows: DataFrame, epoch: int) -> None:
        newest = rows.groupBy("ctx_id").agg(F.max_by("raw", "version").alias("raw")).persist()
        try:
            handle(newest, epoch)
        except Exception:
            log.exception("batch %s failed; its contexts are taken one by one", epoch)
            for row in newest.select("ctx_id").toLocalIterator():
                one = newest.where(F.col("ctx_id").eqNullSafe(row[0]))
                try:
                    handle(one, epoch)
                except Exception:
                    log.exception("context %s failed; the watch goes on", row[0])
                    if errors is not None:
                        errors(one, epoch)
        finally:
            newest.unpersist()

    stream = spark.readStream.schema(RAW_SCHEMA).parquet(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


REQUEST_SCHEMA = "request_id long, path string, body string"
#: Where requests go that are optimized; others pass.
CHAT_PATH = "/v1/chat/completions"


def optimize_requests(requests: DataFrame, strategies: list[str], budget: int | None = None, dry_run: bool = False, config: PipelineConfig = PipelineConfig(), counter: TokenCounter = bytes4) -> DataFrame:
    """request_id, body (as it goes on), model, outcome columns of the log, for requests (request_id, path, body).

    Messages that aren't all of role and string content fall back to the body as it came, and count as failed; a
    body without messages passes, as does another path. ``dry_run`` measures and sends on what came.
    """
    resolve(strategies)
    v = requests.withColumn("v", F.expr("try_parse_json(body)")).withColumn("is_chat", F.coalesce(F.col("path") == CHAT_PATH, F.lit(True)))
    v = v.selectExpr("request_id", "body", "v", "is_chat", "coalesce(try_variant_get(v, '$.model', 'string'), 'unknown') AS model", "coalesce(try_variant_get(v, '$.stream', 'boolean'), false) AS is_streaming", "try_variant_get(v, '$.messages', 'array<variant>') AS items")
    text = lambda key: f"CASE WHEN schema_of_variant(try_variant_get(m, '$.{key}', 'variant')) = 'STRING' THEN try_variant_get(m, '$.{key}', 'string') END"
    v = v.withColumn("messages", F.expr(f"transform(items, m -> named_struct('role', {text('role')}, 'content', {text('content')}, 'relevance_score', try_variant_get(m, '$.relevance_score', 'double')))"))
    v = v.withColumns({"has": F.col("is_chat") & F.coalesce(F.size("items") > 0, F.lit(False)), "fits": F.coalesce(F.forall("messages", lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))})
    used = v.where("has AND fits").select(F.col("request_id").alias("ctx_id"), F.posexplode("messages").alias("pos", "m")).select("ctx_id", "pos", "m.*")
    before = build_chunks(used, counter)
    after = optimize(before, strategies, budget=budget, config=config) if strategies else before
    total = lambda df, c: df.groupBy("ctx_id").agg(F.sum("token_count").alias(c))
    sent = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    new = after.groupBy("ctx_id").agg(F.sum("token_count").alias("optimized_tokens"), F.to_json(sent).alias("new_messages"))
    rows = v.join(total(before, "original_tokens"), v["request_id"] == F.col("ctx_id"), "left").drop("ctx_id").join(new, v["request_id"] == F.col("ctx_id"), "left").drop("ctx_id")
    others = F.expr("map_filter(CAST(try_variant_get(v, '$', 'map<string,variant>') AS map<string,variant>), (k, x) -> k <> 'messages')")
    fields = F.array_join(F.transform(F.map_entries(others), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.to_json(e["value"]))), ",")
    body = F.concat(F.lit("{"), fields, F.when(fields != "", ",").otherwise(""), F.lit('"messages":'), "new_messages", F.lit("}"))
    did = F.col("has") & F.col("fits")
    zero = F.lit(0).cast("long")
    return rows.select("request_id", F.when(did & F.lit(not dry_run), body).otherwise(F.col("body")).alias("body"), "model", F.array(*map(F.lit, strategies)).cast("array<string>").alias("strategies"), F.coalesce("original_tokens", zero).alias("original_tokens"), F.coalesce("optimized_tokens", zero).alias("optimized_tokens"), did.alias("was_optimized"), (F.col("has") & ~F.col("fits")).alias("was_fallback"), "is_streaming", F.lit(0).cast("long").alias("latency_ms"))


def serve(spark: SparkSession, source: str, output: str, checkpoint: str, strategies: list[str], budget: int | None = None, dry_run: bool = False, config: PipelineConfig = PipelineConfig(), interval: str | None = "1 second") -> StreamingQuery:
    """Optimize the requests that appear below ``source`` (Parquet of request_id, path, body); bodies and the log go to ``output``."""
    def batch(rows: DataFrame, epoch: int) -> None:
        done = optimize_requests(rows, strategies, budget, dry_run, config).persist()
        done.select("request_id", "body").write.mode("overwrite").parquet(f"{output}/bodies/epoch={epoch}")
        done.select(*REQUEST_LOG.names).write.mode("overwrite").parquet(f"{output}/log/epoch={epoch}")
        done.unpersist()

    stream = spark.readStream.schema(REQUEST_SCHEMA).parquet(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def running_metrics(requests: DataFrame) -> DataFrame:
    """Streaming figures for each model: a state of one row for each model that was seen."""
    saved = F.greatest(F.col("original_tokens") - F.col("optimized_tokens"), F.lit(0))
    return requests.where("original_tokens > 0").groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum(saved).alias("tokens_saved"))


def running_last(requests: DataFrame) -> DataFrame:
    """The latest request so far: a state of one row."""
    return requests.groupBy().agg(F.max_by(F.struct("model", "original_tokens", "optimized_tokens", "latency_ms"), "request_id").alias("last_request"))


#: Paths that are answered here, and what with; other paths pass.
ANSWERS = {"/health": '{"status":"ok"}'}


def answered(requests: DataFrame) -> DataFrame:
    """request_id, answer of the requests (request_id, path, body) that need no provider; the others have a null answer and go on."""
    answer = F.lit(None).cast("string")
    for path, text in ANSWERS.items():
        answer = F.when(F.col("path") == path, text).otherwise(answer)
    return requests.select("request_id", answer.alias("answer"))


def windowed_metrics(requests: DataFrame, time: str = "ts", late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Figures for each model and span of time; what comes later than ``late`` is left out."""
    return requests.withWatermark(time, late).groupBy(F.window(time, every), "model").agg(F.count(F.lit(1)).alias("requests"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"))
