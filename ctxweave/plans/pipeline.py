"""Strategies by name, presets, and running them one after the other."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TokenCounter, bytes4
from ..operators.bookend import bookend
from ..operators.budget import budget_warnings, truncate_to_budget
from ..operators.chunks import with_zones
from ..operators.dedup import dedup_exact, dedup_semantic
from ..operators.prune import prune
from ..operators.structural import structural
from ..operators.summarize import RECENT, summarize
from ..sources.config import Config, chosen
from ..sources.providers import EmbeddingProvider, LlmProvider, embedding_provider, llm_provider


@dataclass(frozen=True)
class PipelineConfig:
    query: str | None = None
    counter: TokenCounter = bytes4
    embedding_provider: EmbeddingProvider | None = None
    dedup_threshold: float = 0.85
    prune_threshold: float = 0.3
    llm_provider: LlmProvider | None = None
    recent_turns: int = RECENT


class Strategy(Protocol):
    """Any function of a chunk table that returns one, with dense positions."""

    def __call__(self, chunks: DataFrame, config: PipelineConfig) -> DataFrame: ...


def _dedup(chunks: DataFrame, c: PipelineConfig) -> DataFrame:
    return dedup_exact(chunks) if c.embedding_provider is None else dedup_semantic(chunks, c.embedding_provider, c.dedup_threshold, c.counter)


STRATEGIES: dict[str, Strategy] = {
    "bookend": lambda df, c: bookend(df, c.query),
    "structural": lambda df, c: structural(df, c.query, c.counter),
    "dedup": _dedup,
    "prune": lambda df, c: prune(df, c.prune_threshold, c.counter),
    "summarize": lambda df, c: summarize(df, c.llm_provider, c.counter, c.recent_turns),
}
PRESETS = {"safe": ["bookend"], "balanced": ["bookend", "structural"], "aggressive": ["bookend", "structural", "dedup", "prune", "summarize"]}


def register(name: str, strategy: Strategy) -> None:
    """Make a strategy of your own known by ``name``."""
    if name in STRATEGIES:
        raise ValueError(f"strategy exists: {name}")
    STRATEGIES[name] = strategy


def resolve(strategies: list[str] | None = None, preset: str | None = None) -> list[str]:
    """Names of the strategies to run: the preset's, else those given, else bookend. Unknown names raise before any plan is built."""
    if preset is not None:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset: {preset}")
        return PRESETS[preset]
    names = strategies or ["bookend"]
    if unknown := [n for n in names if n not in STRATEGIES]:
        raise ValueError(f"unknown strategy: {', '.join(unknown)}")
    return names


def run(chunks: DataFrame, strategies: list[str], config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """The strategies in their order, as one plan. Attention zones are those of the input until ``finish``."""
    return reduce(lambda df, name: STRATEGIES[name](df, config), resolve(strategies), chunks)


def finish(chunks: DataFrame, budget: int | None = None) -> DataFrame:
    """Within ``budget``, if one is given, and with attention zones anew."""
    return with_zones(chunks if budget is None else truncate_to_budget(chunks, budget)).select(*chunks.columns)


def optimize(chunks: DataFrame, strategies: list[str] | None = None, preset: str | None = None, budget: int | None = None, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    if budget is not None and budget <= 0:
        raise ValueError("the budget must be positive")
    return finish(run(chunks, resolve(strategies, preset), config), budget)


def optimize_warnings(chunks: DataFrame, strategies: list[str] | None = None, preset: str | None = None, budget: int = 1, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    return budget_warnings(run(chunks, resolve(strategies, preset), config), budget)


def compress(chunks: DataFrame, budget: int, query: str | None = None, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Structural compression, then the budget."""
    return optimize(chunks, ["structural"], budget=budget, config=replace(config, query=query))


def explain_steps(chunks: DataFrame, strategies: list[str], config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """step, strategy, before_tokens, after_tokens over all contexts, for each strategy in turn.

    Each strategy runs once, over what the one before left, which is kept (in memory and on disk) meanwhile.
    """
    total = lambda df: df.agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0]
    kept, rows = [chunks.persist()], []
    try:
        tokens = [total(chunks)]
        for step, name in enumerate(resolve(strategies)):
            kept.append(STRATEGIES[name](kept[-1], config).persist())
            tokens.append(total(kept[-1]))
            rows.append((step, name, tokens[-2], tokens[-1]))
    finally:
        for df in kept:
            df.unpersist()
    return chunks.sparkSession.createDataFrame(rows, "step int, strategy string, before_tokens long, after_tokens long")


def configured(c: Config, recent: int = RECENT) -> PipelineConfig:
    """What a settings file says about the strategies; what it leaves open is the default."""
    default = PipelineConfig()
    return PipelineConfig(
        embedding_provider=embedding_provider(c.dedup_provider), dedup_threshold=chosen(None, c.dedup_threshold, default.dedup_threshold), prune_threshold=chosen(None, c.prune_threshold, default.prune_threshold),
        llm_provider=llm_provider(c.llm_provider, c.llm_model), recent_turns=chosen(None, c.recent_turns, recent),
    )


def optimize_configured(chunks: DataFrame, c: Config, strategies: list[str] | None = None, preset: str | None = None, budget: int | None = None) -> DataFrame:
    """``optimize`` with a settings file's strategies, budget and thresholds where the call gives none."""
    return optimize(chunks, chosen(strategies, None if preset else c.strategies, None), preset, chosen(budget, c.budget, None), configured(c))
