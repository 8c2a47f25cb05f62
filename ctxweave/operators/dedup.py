"""Removing repeated chunks of a context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import TokenCounter, bytes4
from ..sources.providers import EmbeddingProvider
from .chunks import with_dense_positions
from .tfidf import Sparse, TfIdf

#: A sentence of a dropped chunk is kept where it is less alike to the kept chunk than this.
NOVEL = 0.7


def dedup_exact(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content in each context."""
    first = F.row_number().over(Window.partitionBy("ctx_id", "content").orderBy("pos")) == 1
    return with_dense_positions(chunks.withColumn("__first", first).where("__first").drop("__first"), "pos")


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision over the shorter length, norms over all of each; 0 for a zero norm."""
    n = min(len(a), len(b))
    a, b = a.astype(np.float64), b.astype(np.float64)
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(np.clip(a[:n] @ b[:n] / size, -1, 1)) if size > 0 else 0.0


def cosine_rows(vectors: list[np.ndarray], block: int = 256) -> Iterator[np.ndarray]:
    """For each vector its cosine with all; vectors of one length as products of ``block`` rows with the whole matrix."""
    if len({len(v) for v in vectors}) > 1:
        yield from (np.array([cosine(a, b) for b in vectors]) for a in vectors)
        return
    m = np.stack(vectors).astype(np.float64) if vectors else np.zeros((0, 0))
    norm = np.sqrt((m * m).sum(1))
    for at in range(0, len(m), block):
        size = norm[at : at + block, None] * norm[None, :]
        yield from np.clip(np.divide(m[at : at + block] @ m.T, size, out=np.zeros_like(size), where=size > 0), -1, 1)


def sentences(text: str) -> list[str]:
    pieces = (s.strip() for line in text.split("\n") for s in line.split(". "))
    return [s for s in pieces if len(s.encode()) > 5]


class _Densely:
    """Vectors of any provider."""

    def __init__(self, texts: list[str], provider: EmbeddingProvider, shared_vocabulary: bool):
        self.texts, self.provider, self.shared_vocabulary = texts, provider, shared_vocabulary
        self.vectors = [np.asarray(v, np.float32) for v in provider.embed(texts)]
        if len(self.vectors) != len(texts):
            raise ValueError(f"{len(self.vectors)} vectors for {len(texts)} chunks")
        self.own: list[np.ndarray] = []
        self.first: list[int] = []

    def alike(self, threshold: float) -> Iterator[Callable[[], list[int]]]:
        """For each chunk what gives the later ones like it."""
        for i, x in enumerate(cosine_rows(self.vectors)):
            yield lambda: (np.nonzero(x[i + 1 :] >= threshold)[0] + i + 1).tolist()  # noqa: B023

    def to_kept(self, drop: int, parts: list[str], keep: int) -> list[float]:
        """The cosines of a chunk's sentences with another chunk."""
        if not self.shared_vocabulary:
            return [cosine(np.asarray(v, np.float32), self.vectors[keep]) for v in self.provider.embed(parts)]
        if not self.own:  # all chunks and all their sentences, once
            every = [sentences(t) for t in self.texts]
            self.first = [*accumulate([len(self.texts), *(len(x) for x in every)])]
            self.own = [np.asarray(v, np.float32) for v in self.provider.embed([*self.texts, *(s for x in every for s in x)])]
        return [cosine(v, self.own[keep]) for v in self.own[self.first[drop] : self.first[drop] + len(parts)]]


class _Sparsely:
    """The same by TF-IDF, without a matrix of chunks and words; equal texts are compared once."""

    def __init__(self, texts: list[str], provider: TfIdf, shared_vocabulary: bool):
        self.texts, self.provider, self.shared_vocabulary = texts, provider, shared_vocabulary
        self.vectors = provider.sparse(texts)
        self.own: Sparse | None = None
        self.first: list[int] = []

    def alike(self, threshold: float) -> Iterator[Callable[[], list[int]]]:
        copies: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            copies.setdefault(t, []).append(i)
        of = [copies[t] for t in self.texts]
        first = np.array([c[0] for c in of])
        links: dict[int, list[int]] = {}  # between first copies
        for i, later in enumerate(self.vectors.alike(threshold, np.unique(first))):
            for j in later.tolist():
                links.setdefault(i, []).append(j)
                links.setdefault(j, []).append(i)
        for i, mine in enumerate(of):
            a = mine[0]
            yield lambda: sorted(j for x in [*links.get(a, []), *([a] if self.vectors.norm[a] > 0 and threshold <= 1 else [])] for j in of[x] if j > i)  # noqa: B023

    def to_kept(self, drop: int, parts: list[str], keep: int) -> list[float]:
        if not self.shared_vocabulary:
            return self.provider.sparse(parts).cosines(0, len(parts), self.vectors, keep).tolist()
        if self.own is None:  # all chunks and all their sentences, once
            self.first = [*accumulate([len(self.texts), *(len(sentences(t)) for t in self.texts)])]
            self.own = self.provider.sparse(chain(self.texts, (s for t in self.texts for s in sentences(t))))
        return self.own.cosines(self.first[drop], self.first[drop] + len(parts), self.own, keep).tolist()


def resolve(texts: list[str], tokens: list[int], provider: EmbeddingProvider, threshold: float, shared_vocabulary: bool) -> tuple[list[int], dict[int, list[str]]]:
    """Positions that stay, and sentences that are added to them.

    Pairs are met in order; of two alike the one with more tokens stays (the earlier on a tie). A chunk
    dropped while it is the first of the pairs goes on dropping others, as pairs are only skipped
    before that. With ``shared_vocabulary`` sentences are compared by vectors over all chunks of the context and all their
    sentences, else by vectors of their own.
    """
    use = _Sparsely(texts, provider, shared_vocabulary) if isinstance(provider, TfIdf) and threshold > 0 else _Densely(texts, provider, shared_vocabulary)
    gone: set[int] = set()
    added: dict[int, list[str]] = {}
    for i, alike_to in enumerate(use.alike(threshold)):
        if i in gone:
            continue
        for j in alike_to():
            if j in gone:
                continue
            keep, drop = (i, j) if tokens[i] >= tokens[j] else (j, i)
            parts = sentences(texts[drop])
            if len(parts) > 1:
                added.setdefault(keep, []).extend(s for s, x in zip(parts, use.to_kept(drop, parts, keep), strict=True) if x < NOVEL)
            gone.add(drop)
    return [i for i in range(len(texts)) if i not in gone], {k: v for k, v in added.items() if v}


def dedup_semantic(chunks: DataFrame, provider: EmbeddingProvider | None = None, threshold: float = 0.85, counter: TokenCounter = bytes4, shared_vocabulary: bool = False) -> DataFrame:
    """Chunks of which no two are alike by the cosine of their vectors; what is new in a dropped one joins the kept.

    The elimination depends on the order of all of a context's chunks, so each context is one group; contexts of
    one chunk don't go through Python. ``provider`` is TF-IDF over the context unless given.
    """
    use = provider or TfIdf()
    single = F.count(F.lit(1)).over(Window.partitionBy("ctx_id")) < 2
    rows = chunks.withColumn("__single", single)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        stay, added = resolve(pdf["content"].tolist(), pdf["token_count"].tolist(), use, threshold, shared_vocabulary)
        pdf["__changed"] = False
        staying = set(stay)
        for i, extra in added.items():
            if i in staying:
                pdf.loc[i, "content"] = pdf.loc[i, "content"] + "\n\n[merged from duplicate]: " + ". ".join(extra)
                pdf.loc[i, "__changed"] = True
        return pdf.loc[stay]

    many = rows.where("not __single").drop("__single")
    schema = many.withColumn("__changed", F.lit(False)).schema
    out = many.groupBy("ctx_id").applyInPandas(run, schema).unionByName(rows.where("__single").drop("__single").withColumn("__changed", F.lit(False)))
    out = out.withColumn("token_count", F.when(F.col("__changed"), counter(F.col("content"))).otherwise(F.col("token_count"))).drop("__changed")
    return with_dense_positions(out, "pos")

