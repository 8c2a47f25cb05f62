"""Token counters: what a chunk costs."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TokenCounter = Callable[[Column], Column]


def bytes4(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up: an estimate that needs no vocabulary and stays in the JVM."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(4.0)).cast("long")


def bpe(ranks_path: str, pattern: str, special: dict[str, int] | None = None) -> TokenCounter:
    """Exact counts by a byte-pair vocabulary: a file of base64 tokens and ranks. Special strings count as one token."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        count_one = (lambda t: len(encoding.encode(t, allowed_special="all"))) if special else lambda t: len(encoding.encode_ordinary(t))
        for part in parts:
            yield part.fillna("").map(count_one)

    return count


#: How byte-level vocabularies of this kind cut a text before they merge bytes.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public_bpe(name: str = "byte_bpe_50k.tiktoken") -> TokenCounter:
    """A counter by a public vocabulary file in the folder CTXWEAVE_TOKENIZERS, or of the package ``public_tokenizers``."""
    folder = os.environ.get("CTXWEAVE_TOKENIZERS")
    if folder:
        return bpe(os.path.join(folder, name), BYTE_LEVEL)
    import public_tokenizers

    return bpe(public_tokenizers.path(name), BYTE_LEVEL)


def word_estimate(n_words: Column) -> Column:
    """Tokens of so many words, at three words to four tokens."""
    return F.round(n_words / F.lit(0.75)).cast("long")
