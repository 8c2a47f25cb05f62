"""What an engine may ask from outside: vectors and texts. Any object with the method will do."""

from __future__ import annotations

import json
import os
import urllib.request
from typing import Protocol


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LlmProvider(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


def _post(url: str, body: dict, timeout: int, key: str | None = None) -> dict:
    headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())


class LocalEmbeddings:
    """An embedding server on this machine's network, asked text by text."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "nomic-embed-text") -> None:
        self.url, self.model = url, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [_post(f"{self.url}/api/embeddings", {"model": self.model, "prompt": t}, 60)["embedding"] for t in texts]


class HostedEmbeddings:
    """A hosted embedding service, asked for all texts at once."""

    def __init__(self, key: str | None = None, model: str = "text-embedding-3-small", url: str = "https://api.openai.com") -> None:
        self.key, self.model, self.url = key or os.environ["OPENAI_API_KEY"], model, url

    def embed(self, texts: list[str]) -> list[list[float]]:
        data = _post(f"{self.url}/v1/embeddings", {"model": self.model, "input": texts}, 60, self.key)["data"]
        return [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]


class LocalLlm:
    def __init__(self, url: str = "http://localhost:11434", model: str = "llama3.2", temperature: float = 0.3) -> None:
        self.url, self.model, self.temperature = url, model, temperature

    def complete(self, system: str, prompt: str) -> str:
        body = {"model": self.model, "system": system, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature}}
        return _post(f"{self.url}/api/generate", body, 120)["response"].strip()


class HostedLlm:
    def __init__(self, key: str | None = None, model: str = "gpt-4o-mini", url: str = "https://api.openai.com", temperature: float = 0.3) -> None:
        self.key, self.model, self.url, self.temperature = key or os.environ["OPENAI_API_KEY"], model, url, temperature

    def complete(self, system: str, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        return _post(f"{self.url}/v1/chat/completions", body, 120, self.key)["choices"][0]["message"]["content"].strip()


def embedding_provider(name: str | None) -> EmbeddingProvider | None:
    from ..operators.tfidf import TfIdf

    known = {"tfidf": TfIdf, "ollama": LocalEmbeddings, "openai": HostedEmbeddings}
    if name is None:
        return None
    if name not in known:
        raise ValueError(f"unknown embedding provider: {name}")
    return known[name]()


def llm_provider(name: str | None, model: str | None = None) -> LlmProvider | None:
    known = {"ollama": LocalLlm, "openai": HostedLlm}
    if name is None:
        return None
    if name not in known:
        raise ValueError(f"unknown LLM provider: {name}")
    return known[name](**({"model": model} if model else {}))
