"""The commands, each over all contexts of a table at once, and how results are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TokenCounter, bytes4
from ..operators import diff as diffs
from ..operators import health
from ..operators.chunks import build_chunks, count_tokens, to_messages
from ..sources.formats import parse_messages
from ..sources.providers import LlmProvider
from ..sources.transcript import is_transcript, normalize, parse_transcript, transcript_lines
from .pipeline import compress, optimize

__all__ = ["analyze", "compress", "count", "diff", "load", "optimize", "pretty_messages", "show_chunks", "show_dashboard", "show_diff", "show_report", "summarize_text", "write_messages", "write_pretty"]


def load(raw: DataFrame, input_format: str = "auto", transcripts: bool = False, counter: TokenCounter = bytes4) -> DataFrame:
    """The chunk table of whole texts (ctx_id, raw and perhaps path). With ``transcripts``, texts that look like one are read so."""
    fmt = None if input_format == "auto" else input_format
    if not transcripts or fmt is not None:
        return build_chunks(parse_messages(raw, fmt).where("error is null"), counter)
    path = F.col("path") if "path" in raw.columns else F.lit(None).cast("string")
    told = raw.withColumn("__t", is_transcript(path, F.col("raw")))
    chat = build_chunks(parse_messages(told.where("not __t")).where("error is null"), counter)
    return chat.unionByName(normalize(parse_transcript(transcript_lines(told.where("__t"))), counter))


def analyze(chunks: DataFrame, model: str = "gpt-4o", output: str = "table") -> DataFrame:
    if output not in ("table", "json"):
        raise ValueError(f"unknown output: {output}")
    report = health.analyze(chunks, model)
    return health.to_json(report) if output == "json" else report


def count(chunks: DataFrame) -> DataFrame:
    return count_tokens(chunks)


def diff(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """summary, moved, compressed and removed."""
    rest = diffs.compressed_and_removed(before, after)
    return {"summary": diffs.diff_summary(before, after), "moved": diffs.moved(before, after), "compressed": rest.where("after_tokens is not null"), "removed": rest.where("after_tokens is null")}


def summarize_text(raw: DataFrame, provider: LlmProvider) -> DataFrame:
    """ctx_id, summary of whole texts (ctx_id, raw)."""
    import pandas as pd

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: provider.complete("You are a precise summarizer.", t))

    return raw.select("ctx_id", ask("raw").alias("summary"))


def pretty_messages(chunks: DataFrame) -> DataFrame:
    """ctx_id, json: each context's messages as an indented array of role and content."""
    return to_messages(chunks).select("ctx_id", F.to_json("messages", {"pretty": "true"}).alias("json"))


def write_pretty(chunks: DataFrame, path: str) -> None:
    """Each context's array in a folder of its own, ``ctx_id=...``, as text."""
    pretty_messages(chunks).write.mode("overwrite").partitionBy("ctx_id").text(path)


def write_messages(chunks: DataFrame, path: str) -> None:
    """Each context's messages as a line of JSON."""
    to_messages(chunks).select(F.to_json(F.struct("ctx_id", "messages")).alias("value")).write.mode("overwrite").text(path)


def show_report(row: dict) -> str:
    """A context's report as text for a terminal."""
    lines = [f"Context health: {row['health_score']}/100  {row['status']}", f"Tokens: {row['total_tokens']:,} in {row['n_chunks']:,} chunks"]
    lines += [f"{name:<12}{row[score]:>4}/100" for name, score in (("Dead zone", "dead_zone_score"), ("Duplication", "duplication_score"), ("Budget", "budget_score"))]
    return "\n".join([*lines, *(f"- {r}" for r in row["recommendations"])])


def _table(head: list[str], rows: list[list[str]]) -> str:
    """Columns under their names, the first to the left, the others to the right."""
    width = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    line = lambda r: "  ".join([r[0].ljust(width[0]), *(x.rjust(w) for x, w in zip(r[1:], width[1:], strict=True))]).rstrip()
    return "\n".join([line(head), "─" * (sum(width) + 2 * len(width) - 2), *map(line, rows)])


def show_chunks(rows: list[dict]) -> str:
    """A context's chunks, in order, as text for a terminal."""
    zones = {"dead_zone": "DEAD ZONE", "strong": "STRONG"}
    return _table(["idx", "role", "tokens", "zone", "relevance"], [[str(r["chunk_index"]), r["role"], f"{r['token_count']:,}", zones[r["attention_zone"]], f"{r['relevance_score']:.2f}"] for r in sorted(rows, key=lambda r: r["pos"])])


def _change(before: float, after: float) -> str:
    return "—" if before in (0, after) else f"{(after - before) / before * 100:+.1f}%"


def show_diff(summary: dict, moved: list[dict] = (), compressed: list[dict] = (), removed: list[dict] = (), most: int = 5) -> str:
    """What ``diff`` found for one context as text for a terminal; of each kind of change the first ``most``."""
    names = {"tokens": "Total tokens", "messages": "Messages", "dead_zone_tokens": "Dead zone tokens", "duplicate_tokens": "Duplicate tokens"}
    rows = [[shown, f"{summary[f'before_{n}']:,}", f"{summary[f'after_{n}']:,}", _change(summary[f"before_{n}"], summary[f"after_{n}"])] for n, shown in names.items()]
    a, b = summary["before_health_score"], summary["after_health_score"]
    out = [_table(["Metric", "Before", "After", "Change"], [*rows, ["Health score", str(a), str(b), "—" if a == b else f"{b - a:+d}"]])]
    for title, found, line in (
        ("Moved", moved, lambda r: f"message {r['pos_before']} ({r['role']}): position {r['pos_before']} -> {r['pos_after']}"),
        ("Compressed", compressed, lambda r: f"message {r['pos_before']} ({r['role']}): {r['before_tokens']:,} -> {r['after_tokens']:,} tokens"),
        ("Removed", removed, lambda r: f"message {r['pos_before']} ({r['role']}): {r['before_tokens']:,} tokens"),
    ):
        if found:
            rest = [f"  and {len(found) - most} more"] if len(found) > most else []
            out.append("\n".join([f"{title}: {len(found)}", *(f"  {line(r)}" for r in found[:most]), *rest]))
    return "\n\n".join(out)


def show_dashboard(snapshot: dict, uptime_seconds: int) -> str:
    """A snapshot of the metrics as text that a terminal may show over and over."""
    total, saved = snapshot["input_original"], snapshot["saved"]
    last = snapshot.get("last_request")
    told = "none yet"
    if last is not None:
        a, b = last["original_tokens"], last["optimized_tokens"]
        told = f"{last['model']} | {a}->{b}  ({(b - a) / a * 100:.1f}%)" if a > 0 else f"{last['model']} | passthrough"
    h, rest = divmod(uptime_seconds, 3600)
    return "\n".join([
        f"Uptime: {h:02d}h {rest // 60:02d}m {rest % 60:02d}s    Requests: {snapshot['total']:,}",
        f"Tokens saved: {saved:,} ({f'{saved / total * 100:.1f}%' if total else '—'})",
        f"Est. cost saved: ${snapshot['estimated_saved_usd']:.2f}",
        f"Avg optimization latency: {snapshot['avg_optimize_latency_ms']:.1f}ms",
        f"Last: {told}",
    ])
