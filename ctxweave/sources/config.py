"""Options from a TOML file: the project's, else the user's, else defaults; the first that is there counts alone."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Config:
    model: str | None = None
    format: str | None = None
    strategies: list[str] | None = None
    budget: int | None = None
    dedup_threshold: float | None = None
    dedup_provider: str | None = None
    prune_threshold: float | None = None
    llm_provider: str | None = None
    llm_model: str | None = None
    recent_turns: int | None = None
    requests: dict = field(default_factory=dict)
    source: str = "defaults"


_PLACES = {
    "model": ("default", "model"), "format": ("default", "format"), "strategies": ("optimize", "strategies"), "budget": ("optimize", "budget"),
    "dedup_threshold": ("dedup", "threshold"), "dedup_provider": ("dedup", "embedding_provider"), "prune_threshold": ("prune", "threshold"),
    "llm_provider": ("summarize", "llm_provider"), "llm_model": ("summarize", "llm_model"), "recent_turns": ("summarize", "recent_turns"),
}


def parse(text: str, source: str) -> Config:
    """A budget of 0 is none."""
    raw = tomllib.loads(text)
    requests = dict(raw.get("proxy", {}))
    if requests.get("budget") == 0:
        requests["budget"] = None
    values = {name: raw.get(section, {}).get(key) for name, (section, key) in _PLACES.items()}
    values["budget"] = values["budget"] or None
    return Config(**values, requests=requests, source=source)


def load(project: Path = Path("ctxweave.toml"), user: Path = Path.home() / ".config/ctxweave/config.toml") -> Config:
    for path in (project, user):
        if path.is_file():
            return parse(path.read_text(), str(path))
    return Config()


def chosen(given: object, configured: object, default: object) -> object:
    """An argument, else the file's value, else the default."""
    return given if given is not None else configured if configured is not None else default


